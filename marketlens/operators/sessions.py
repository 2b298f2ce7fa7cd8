"""Cutting a time-ordered history per key into sessions, without one task per key.

Both rules depend on order, so a plain implementation sorts a key's whole history in one
place. Here a history is cut into time chunks (a week by default) that are handled
independently, and only one small record per chunk travels along the key's calendar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.numbers import fixed
from marketlens.functions.rows import written
from marketlens.plans.tables import Tables

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
SESSION_SECONDS = 7200
CHUNK_SECONDS = 7 * 86_400
MICRO = 1_000_000
CELL = ["key", "island", "chunk"]


def _instants(df: DataFrame, key: str, ts: str, sums: dict[str, Column]) -> DataFrame:
    """One row per key and distinct instant, in microseconds, with the wanted sums. Rows without
    key or instant are in no session."""
    micros = F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{ts}`)")
    return df.groupBy(F.col(key).alias("key"), micros.alias("at")).agg(
        *[F.sum(value).alias(name) for name, value in sums.items()]).where(
        "key IS NOT NULL AND at IS NOT NULL")


def _published(sessions: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    # adding to a zone-free epoch, as timestamp_micros would apply the session's zone
    at = lambda c: F.expr(f"timestampadd(MICROSECOND, {c}, {EPOCH})")
    return sessions.select(
        F.col("key").alias(key), at("start").alias("start_time"), at("end").alias("end_time"),
        F.floor((F.col("end") - F.col("start")) / F.lit(60 * MICRO)).cast("int")
        .alias("duration_minutes"), *sums)


def _marked(points: DataFrame, gap: int, span: int, sums: dict[str, Column]) -> DataFrame:
    """What a chunk alone tells of its instants, in one pass, written down.

    ``piece`` is the first instant of their run without a longer gap inside the chunk. An
    instant is ``alone`` if it has no neighbour within the gap, in whatever chunk.
    """
    cell = Window.partitionBy("key", "chunk").orderBy("at")
    first = F.col("before").isNull() | (F.col("at") - F.col("before") > gap)
    last = F.col("after").isNull() | (F.col("after") - F.col("at") > gap)
    begin = F.col("chunk") * span
    inside = (F.col("at") > begin + gap) & (F.col("at") < begin + span - gap)
    return written(
        points.withColumn("chunk", F.expr(f"(at - pmod(at, {span}L)) div {span}L"))
        .select("*", F.lag("at").over(cell).alias("before"), F.lead("at").over(cell).alias("after"))
        .select("key", "chunk", "at", *sums, (first & last & inside).alias("alone"),
                F.max(F.when(first, F.col("at"))).over(
                    cell.rowsBetween(Window.unboundedPreceding, 0)).alias("piece")), "instants")


def _linked(marked: DataFrame, gap: int, sums: dict[str, Column]) -> DataFrame:
    """Pieces of more than one instant or near an end of their chunk, each with the first
    instant of its run (``start``).

    The window holds these pieces of one key. The calendar bounds their number: between any
    two of a chunk lies a gap.
    """
    calendar = Window.partitionBy("key").orderBy("piece")
    before = F.lag("end").over(calendar)
    opens = F.when(before.isNull() | (F.col("piece") - before > gap), F.col("piece"))
    pieces = marked.where("NOT alone").groupBy("key", "chunk", "piece").agg(
        F.max("at").alias("end"), *[F.sum(name).alias(name) for name in sums])
    return pieces.withColumn("opens", opens).withColumn(
        "start", F.max("opens").over(calendar.rowsBetween(Window.unboundedPreceding, 0)))


def _cut(df: DataFrame, key: str, ts: str, sums: dict[str, Column], gap: int, span: int
         ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The marked instants, those that are sessions, the linked pieces and their runs."""
    marked = _marked(_instants(df, key, ts, sums), gap, span, sums)
    linked = _linked(marked, gap, sums)
    kinds = dict(linked.dtypes)
    alone = marked.where("alone").select(
        "key", F.col("at").alias("start"), F.col("at").alias("end"),
        *[F.col(name).cast(kinds[name]).alias(name) for name in sums])
    runs = linked.groupBy("key", "start").agg(
        F.max("end").alias("end"), F.min("chunk").alias("lo"), F.max("chunk").alias("hi"),
        *[F.sum(name).cast(kinds[name]).alias(name) for name in sums])
    return marked, alone, linked, runs


def sessionize_gap(df: DataFrame, key: str, ts: str, sums: dict[str, Column],
                   gap_seconds: int = SESSION_SECONDS,
                   chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """New session when an instant is more than the gap after the *previous* one."""
    _, alone, _, runs = _cut(df, key, ts, sums, gap_seconds * MICRO, chunk_seconds * MICRO)
    return _published(alone.unionByName(runs.drop("lo", "hi")), key, sums)


def _exits(times: np.ndarray, gap: int, entries: int) -> np.ndarray:
    """For each of the first ``entries`` instants taken as a session start: the start of
    the chunk's last session. Found by doubling jumps over all instants at once."""
    n = len(times)
    jump = np.searchsorted(times, times + gap, side="right")
    jump = np.where(jump == n, np.arange(n), jump)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return times[jump[:entries]]
        jump = further


def _handed_over(wide: DataFrame, gap: int, span: int) -> DataFrame:
    """The session start still open when each chunk of a run begins.

    A chunk maps the start open at its beginning to the one open at its end. The map is
    a step function known from the chunk alone, since an open start only decides which
    of the chunk's first instants (up to one gap into it) opens the next session. The
    chunks tabulate their steps independently; a run's few steps are then followed.
    """

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["at"].to_numpy())
        begin = int(pdf["chunk"].iloc[0]) * span
        entries = min(len(times), int(np.searchsorted(times, begin + gap, side="right")) + 1)
        exits = _exits(times, gap, entries)
        # neighbouring entries with the same exit are one step; keep its last instant
        keep = np.append(exits[1:] != exits[:-1], True)
        head = pdf[CELL].iloc[:1].reset_index(drop=True)
        return head.assign(entries=[times[:entries][keep]], exits=[exits[keep]])

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        opened: int | None = None
        handed: list[int | None] = []
        pdf = pdf.sort_values("chunk")
        for entries, exits in zip(pdf["entries"], pdf["exits"]):
            handed.append(opened)
            step = 0 if opened is None else int(
                np.searchsorted(entries, opened + gap, side="right"))
            if step < len(entries):
                opened = int(exits[step])
        return pdf[CELL].assign(opened=pd.array(handed, dtype="Int64"))

    cell = f"key {dict(wide.dtypes)['key']}, island bigint, chunk bigint"
    steps = wide.select(*CELL, "at").groupBy(*CELL).applyInPandas(
        tabulate, f"{cell}, entries array<bigint>, exits array<bigint>")
    return steps.groupBy("key", "island").applyInPandas(follow, f"{cell}, opened bigint")


def _lay_out(gap: int, out: list[str]):
    """Streams rows sorted by cell and instant, marking each with its session's start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        previous: tuple | None = None
        opened: int | None = None
        for pdf in batches:
            if pdf.empty:
                continue
            times = pdf["at"].to_numpy()
            changes = np.zeros(len(pdf), dtype=bool)
            changes[0] = True
            for c in CELL:
                values = pdf[c].to_numpy()
                changes[1:] |= values[1:] != values[:-1]
            bounds = [*np.flatnonzero(changes), len(pdf)]
            start = np.empty(len(pdf), dtype=np.int64)
            for low, high in zip(bounds[:-1], bounds[1:]):
                cell = tuple(pdf[c].iat[low] for c in CELL)
                if cell != previous:
                    handed = pdf["opened"].iat[low]
                    previous, opened = cell, None if pd.isna(handed) else int(handed)
                at = low
                while at < high:
                    if opened is not None:
                        end = at + int(np.searchsorted(times[at:high], opened + gap, side="right"))
                        start[at:end] = opened
                        at = end
                    if at < high:
                        opened = int(times[at])
            yield pdf.assign(start=start)[out]

    return run


def sessionize_anchored(df: DataFrame, key: str, ts: str, sums: dict[str, Column],
                        gap_seconds: int = SESSION_SECONDS,
                        chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """New session when an instant is more than the gap after the session's *start*.

    A longer gap always opens a session, so runs without one are independent, and a run
    no longer than the gap is a session already: both are found JVM-side. Only longer
    runs have order-dependent sessions; they are laid out per (run, chunk) in sorted
    Arrow batches, so that no task holds a key or even a run. The source is read once.
    """
    gap, span = gap_seconds * MICRO, chunk_seconds * MICRO
    marked, alone, linked, runs = _cut(df, key, ts, sums, gap, span)
    length = F.col("end") - F.col("start")
    short = runs.where(length <= gap).drop("lo", "hi")
    long = runs.where(length > gap).select(
        "key", "start", (F.col("lo") < F.col("hi")).alias("wide"))
    parts = linked.select("key", "chunk", "piece", "start").join(long, ["key", "start"]).select(
        "key", "chunk", "piece", F.col("start").alias("island"), "wide")
    dense = marked.where("NOT alone").drop("alone").join(parts, ["key", "chunk", "piece"])
    handed = _handed_over(dense.where("wide"), gap, span)
    kinds = dict(dense.dtypes)
    out = ["key", "at", "start", *sums]
    schema = ", ".join(f"{c} {'bigint' if c == 'start' else kinds[c]}" for c in out)
    laid = (
        dense.join(handed, CELL, "left").repartition(*CELL).sortWithinPartitions(*CELL, "at")
        .mapInPandas(_lay_out(gap, out), schema)
    )
    folded = laid.groupBy("key", "start").agg(
        F.max("at").alias("end"), *[F.sum(name).alias(name) for name in sums])
    return _published(alone.unionByName(short).unionByName(folded), key, sums)


def event_sums() -> dict[str, Column]:
    # cents as integers keep sums exact
    return {"num_events": F.lit(1), "purchases": F.when(F.col("event_type") == "purchase", 1)
            .otherwise(0), "cents": F.round(F.col("value") * 100).cast("bigint")}


def event_sessions(events: DataFrame, anchored: bool = True) -> DataFrame:
    cut = sessionize_anchored if anchored else sessionize_gap
    return cut(events, "user_id", "ts", event_sums()).select(
        "user_id", "start_time", "end_time", "duration_minutes", "num_events", "purchases",
        fixed(F.col("cents") / 100, 2).alias("total_value"))


def betting_sessions(t: Tables) -> DataFrame:
    """Sessions rebuilt from bets: more than two hours after the first bet opens the next."""
    sums = {"num_bets": F.lit(1), "total_wagered": F.col("bet_amount"),
            "net_result": F.col("net_result")}
    cut = sessionize_anchored(t.betting_activity, "customer_id", "bet_date", sums)
    return cut.select(
        F.concat_ws("-", F.lit("SES"), "customer_id", F.date_format("start_time", "yyyyMMddHHmmss"))
        .alias("session_id"), "customer_id", "start_time", "end_time", "duration_minutes",
        *sums)
