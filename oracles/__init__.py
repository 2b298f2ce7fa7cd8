"""Independent DuckDB statements that the Spark results are compared with."""

from oracles.compose import all_statements

__all__ = ["all_statements"]
