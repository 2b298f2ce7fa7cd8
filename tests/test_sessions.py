"""Sessionizers against a plain loop, with runs that cross many chunks and a hot key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators import sessions

BASE = dt.datetime(2024, 1, 1)


def plain(events, gap, anchored):
    out = {}
    for user in {u for u, _ in events}:
        start = last = None
        for at in sorted(s for u, s in events if u == user):
            if start is None or at - (start if anchored else last) > gap:
                start = at
                out[user, start] = [at, 0]
            last = at
            out[user, start][0] = at
            out[user, start][1] += 1
    return {(u, s, e, n) for (u, s), (e, n) in out.items()}


def run(spark, events, gap, chunk, anchored):
    df = spark.createDataFrame(
        [(u, BASE + dt.timedelta(seconds=s)) for u, s in events], "k string, ts timestamp_ntz")
    cut = sessions.sessionize_anchored if anchored else sessions.sessionize_gap
    got = cut(df, "k", "ts", {"n": F.lit(1)}, gap_seconds=gap, chunk_seconds=chunk).collect()
    second = lambda x: int((x - BASE).total_seconds())
    return {(r["k"], second(r["start_time"]), second(r["end_time"]), r["n"]) for r in got}


@pytest.mark.parametrize("anchored", [True, False])
@pytest.mark.parametrize("chunk", [13, 100, 10_000])
def test_against_plain_loop(spark, anchored, chunk):
    random.seed(chunk)
    # one key holds most rows and is dense enough for runs over dozens of chunks
    events = [("hot", random.randrange(0, 3000)) for _ in range(600)]
    events += [(f"u{random.randrange(20)}", random.randrange(0, 3000)) for _ in range(300)]
    events += [("twin", 5)] * 10 + [("edge", s) for s in (0, 20, 40, 41, 61, 62)]
    assert run(spark, events, 20, chunk, anchored) == plain(events, 20, anchored)


def test_anchored_and_gap_rules(spark):
    minutes = [0, 90, 150, 200]
    events = [("a", m * 60) for m in minutes]
    anchored = run(spark, events, 7200, sessions.CHUNK_SECONDS, True)
    assert anchored == {("a", 0, 5400, 2), ("a", 9000, 12000, 2)}
    assert run(spark, events, 7200, sessions.CHUNK_SECONDS, False) == {("a", 0, 12000, 4)}


@pytest.mark.parametrize("anchored", [True, False])
def test_source_is_read_once(spark, anchored):
    # isolated instants, a run over chunks and a dense key: every way of folding is taken
    events = [("a", s) for s in (0, 50, 95, 105, 300)] + [("b", s) for s in range(0, 400, 3)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    df = spark.createDataFrame(
        [(u, BASE + dt.timedelta(seconds=s)) for u, s in events], "k string, ts timestamp_ntz")
    df = df.mapInPandas(counted, df.schema)
    cut = sessions.sessionize_anchored if anchored else sessions.sessionize_gap
    got = {(r["k"], int((r["start_time"] - BASE).total_seconds()),
            int((r["end_time"] - BASE).total_seconds()), r["n"])
           for r in cut(df, "k", "ts", {"n": F.lit(1)}, gap_seconds=20, chunk_seconds=100).collect()}
    assert got == plain(events, 20, anchored)
    assert read.value == len(events)


def test_rows_without_key_or_instant_are_in_no_session(spark):
    df = spark.createDataFrame(
        [("a", BASE), (None, BASE), ("a", None), (None, None)], "k string, ts timestamp_ntz")
    for cut in (sessions.sessionize_anchored, sessions.sessionize_gap):
        got = cut(df, "k", "ts", {"n": F.lit(1)}).collect()
        assert [(r["k"], r["start_time"], r["n"]) for r in got] == [("a", BASE, 1)]
