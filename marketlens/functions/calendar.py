"""Calendar-dense series: a row for every day between a group's first and last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_days(rows: DataFrame, date: str, keys: Sequence[str] = (), zeros: Sequence[str] = (),
               carried: Sequence[str] = (), until: Column | None = None) -> DataFrame:
    """``rows`` (one per group and day) with the missing days of each group filled in.

    A group runs from its first day to its last, or to ``until`` if that is later. On missing
    days ``zeros`` are 0 and ``carried`` repeat the last value that is not null; both rules hold
    for nulls on present days too. Other columns stay null. Rows without a date are left out; a
    null key is a group of its own. ``present`` tells given rows from filled ones.

    Days are gathered by month (31 entries at most) and only months are ordered inside a group,
    so neither an entry list nor a window grows with the data, and the rows are read once.
    """
    others = [c for c in rows.columns if c not in (date, *keys)]
    entry = F.struct(F.col(date).alias("day"), *others)
    months = rows.where(F.col(date).isNotNull()).groupBy(
        *keys, F.trunc(date, "month").alias("_month")).agg(
        F.array_sort(F.collect_list(entry)).alias("_entries"))
    order = Window.partitionBy(*keys).orderBy("_month")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_entries")[0]["day"]
    last = F.element_at("_entries", -1)["day"]
    ahead = F.date_sub(F.lead(first).over(order), 1)

    def latest(c: str, entries: Column) -> Column:
        known = F.filter(entries, lambda e: e[c].isNotNull())
        return F.get(known, F.size(known) - 1)[c]

    stretches = months.select(
        *keys, "_entries", first.alias("_from"),
        F.coalesce(ahead, last if until is None else F.greatest(last, until)).alias("_to"),
        *[F.last(latest(c, F.col("_entries")), ignorenulls=True).over(before).alias(f"_carry_{c}")
          for c in carried])
    days = stretches.withColumn(date, F.explode(F.sequence("_from", "_to")))
    past = F.filter("_entries", lambda e: e["day"] <= F.col(date))

    def value(c: str) -> Column:
        if c in carried:
            return F.coalesce(latest(c, past), F.col(f"_carry_{c}"))
        return F.coalesce(F.col("_own")[c], F.lit(0)) if c in zeros else F.col("_own")[c]

    own = F.filter("_entries", lambda e: e["day"] == F.col(date))
    return days.withColumn("_own", F.get(own, 0)).select(
        *keys, date, *[value(c).alias(c) for c in others], F.col("_own").isNotNull().alias("present"))
