"""Fan-out sums without the fan-out.

Joining k facts to a customer before aggregating repeats every row of one fact once per
combination of rows of the others. The repeated totals are still a function of the
per-fact totals: with n_j rows in fact j, each row of fact i appears
w_i = prod(max(n_j, 1), j != i) times. So sums and counts are multiplied by w_i, while
distinct counts, minima, maxima and means stay. Nothing is ever paired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.numbers import ColumnLike, col


def copies(*counts: ColumnLike) -> Column:
    """How often a row is repeated by the other facts' row counts."""
    # each factor is widened first: a product of bigints overflows at three million cubed
    factors = [F.greatest(F.coalesce(col(c), F.lit(0)), F.lit(1)).cast("decimal(38,0)")
               for c in counts]
    return reduce(lambda a, b: a * b, factors).cast("decimal(38,0)")


def repeated_std(std: ColumnLike, n: ColumnLike, repeats: ColumnLike) -> Column:
    """Sample deviation of n values with the given deviation, each repeated."""
    n, repeats = col(n).cast("double"), col(repeats).cast("double")
    rows = n * repeats
    # squared deviations: (n - 1) * std^2, or 0 for a single value that has no deviation
    squares = F.coalesce(F.pow(col(std), F.lit(2.0)) * (n - 1), F.lit(0.0))
    return F.when(rows > 1, F.sqrt(squares * repeats / (rows - 1)))
