"""Ratios and rounding that are exact on decimals and safe on zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact(c: ColumnLike) -> Column:
    """A count as a decimal, so that a quotient keeps exact halves for rounding."""
    return col(c).cast("decimal(20,0)")


def ratio(top: ColumnLike, bottom: ColumnLike, digits: int | None = None) -> Column:
    """Exact top / bottom, NULL where bottom is 0; rounded half up when digits is given.

    Sums of sums widen to decimal(38,2), whose quotient keeps six digits only and would
    be rounded twice. Narrowing first leaves 18 digits after the point.
    """
    value = F.try_divide(col(top).cast("decimal(28,10)"), col(bottom).cast("decimal(20,2)"))
    return value if digits is None else F.round(value, digits)


def share(top: ColumnLike, bottom: ColumnLike, digits: int | None = None) -> Column:
    """Quotient of two counts."""
    return ratio(exact(top), exact(bottom), digits)


def percent(top: ColumnLike, bottom: ColumnLike, digits: int = 2) -> Column:
    """Quotient of two counts as a percentage."""
    return ratio(exact(top) * F.lit(100), exact(bottom), digits)


def growth(now: ColumnLike, before: ColumnLike, digits: int = 2) -> Column:
    """Relative change in percent; NULL when the earlier value is 0 or absent."""
    return ratio((col(now) - col(before)) * F.lit(100), before, digits)


def zero(c: ColumnLike) -> Column:
    return F.coalesce(col(c), F.lit(0))


def fixed(c: ColumnLike, digits: int) -> Column:
    """Round a binary double half away from zero, without a negative zero."""
    value = col(c).cast("double")
    return F.round(value + F.signum(value) * F.lit(10.0 ** -(digits + 7)), digits) + F.lit(0.0)


def ladder(value: ColumnLike, rungs: list[tuple[object, object]], otherwise: object,
           descending: bool = False) -> Column:
    """First rung whose bound holds: value <= bound, or value >= bound if descending."""
    value = col(value)
    result = None
    for bound, answer in rungs:
        test = value >= F.lit(bound) if descending else value <= F.lit(bound)
        result = F.when(test, F.lit(answer)) if result is None else result.when(test, F.lit(answer))
    return result.otherwise(F.lit(otherwise))
