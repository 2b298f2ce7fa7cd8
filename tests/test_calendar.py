"""Dense calendar series against a plain loop, and users of a period from one read of the facts."""

import datetime as dt
import random

from conftest import SMALL
from pyspark.sql import functions as F

from marketlens.functions.calendar import dense_days
from marketlens.operators import bi, kpis
from marketlens.sources.adapter import from_testdata

SCHEMA = "g string, day date, n long, price double, note string"


def plain(rows, until=None):
    out = []
    for g in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == g and r[1]}
        if not own:
            continue
        now, last, price = min(own), max(own), None
        last = max(last, until) if until else last
        while now <= last:
            _, _, n, p, note = own.get(now, (g, now, None, None, None))
            price = p if p is not None else price
            out.append((g, now, n or 0, price, note, now in own))
            now += dt.timedelta(1)
    return sorted(out, key=str)


def dense(spark, rows, until=None):
    got = dense_days(spark.createDataFrame(rows, SCHEMA), "day", ["g"], ["n"], ["price"],
                     None if until is None else F.lit(until))
    assert got.columns == ["g", "day", "n", "price", "note", "present"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_dense_days(spark):
    r = random.Random(2)
    rows = []
    for g in ("a", "b", None, "single"):
        for k in sorted(r.sample(range(400), 1 if g == "single" else 40)):
            rows.append((g, dt.date(2023, 11, 5) + dt.timedelta(k), r.choice([None, 3]),
                         r.choice([None, None, 1.5, 2.5]), r.choice([None, "x"])))
    rows.append(("a", None, 1, 1.0, "no date"))
    rows.append(("dateless", None, 1, 1.0, "no date"))
    assert dense(spark, rows) == plain(rows)
    until = dt.date(2024, 10, 1)
    assert dense(spark, rows, until) == plain(rows, until)
    assert dense(spark, []) == []


def test_dense_days_carries_over_empty_months(spark):
    rows = [("a", dt.date(2024, 1, 31), 1, 7.0, None), ("a", dt.date(2024, 6, 2), 1, None, None)]
    got = dense(spark, rows)
    assert len(got) == 124 and {r[3] for r in got} == {7.0}


def test_users_of_a_period_read_the_facts_once(spark):
    t = from_testdata(spark, SMALL)
    for frame in (kpis.weekly_trends(t), bi.monthly(t)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert sum("l_orderkey" in line and "Relation" in line for line in plan.splitlines()) == 1


def test_dense_days_keep_their_plan(spark):
    """One shuffle by group and month, one by group."""
    frame = spark.createDataFrame([("a", dt.date(2024, 1, 31), 1, 7.0, None)], SCHEMA)
    plan = dense_days(frame, "day", ["g"], ["n"], ["price"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Join" not in plan
