"""Put shared CTEs in front of a statement and collect all statements."""

from __future__ import annotations

import importlib
import re

from oracles.base import CTES

MODULES = ("kpis", "advanced", "quality", "written", "attribution", "cohorts", "abtests", "features", "bi", "timed",
           "audiences", "budget")


def compose(body: str) -> str:
    """Prefix ``body`` with the CTEs it names, and those that they name."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            pending.append(CTES[name])
    if not needed:
        return body
    listed = ",\n".join(f"{name} AS ({sql})" for name, sql in CTES.items() if name in needed)
    return f"WITH {listed}\nSELECT * FROM ({body}) AS result"


def all_statements() -> dict[str, str]:
    statements: dict[str, str] = {}
    for module in MODULES:
        found = importlib.import_module(f"oracles.{module}").STATEMENTS
        overlap = statements.keys() & found.keys()
        if overlap:
            raise ValueError(f"statement given twice: {sorted(overlap)}")
        statements.update({key: compose(sql) for key, sql in found.items()})
    return statements
