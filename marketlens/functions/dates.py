"""Date arithmetic with the semantics the measures need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.numbers import ColumnLike, col

_DAY_MICROS = 86_400_000_000


def _ntz(c: ColumnLike) -> Column:
    return col(c).cast("timestamp_ntz")


def whole_days(start: ColumnLike, end: ColumnLike) -> Column:
    """Complete 24-hour periods between two instants, toward zero."""
    return F.timestamp_diff("DAY", _ntz(start), _ntz(end))


def floor_days(start: ColumnLike, end: ColumnLike) -> Column:
    """Complete 24-hour periods, toward minus infinity."""
    micros = F.timestamp_diff("MICROSECOND", _ntz(start), _ntz(end))
    return F.floor(micros / F.lit(_DAY_MICROS)).cast("long")


def day(c: ColumnLike) -> Column:
    return F.to_date(col(c))


def month_start(c: ColumnLike) -> Column:
    return F.trunc(day(c), "month")


def week_start(c: ColumnLike) -> Column:
    """Monday of the week."""
    return F.trunc(day(c), "week")


def month_offset(start: ColumnLike, end: ColumnLike) -> Column:
    """Calendar months from one month start to another."""
    start, end = col(start), col(end)
    return (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))


def week_offset(start: ColumnLike, end: ColumnLike) -> Column:
    """Weeks from one Monday to another."""
    return (F.datediff(col(end), col(start)) / 7).cast("int")


def period_start(c: ColumnLike, period: str) -> Column:
    return {"monthly": month_start, "weekly": week_start}[period](c)


def period_offset(start: ColumnLike, end: ColumnLike, period: str) -> Column:
    return {"monthly": month_offset, "weekly": week_offset}[period](start, end)
