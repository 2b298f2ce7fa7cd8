"""Mixing sources to target weights, without Python on the executors.

The words of a source form one stream: its documents in the order of a hash, cut into
blocks of ``BLOCK`` words, the last one shorter. Targets share all words by weight; a
target stops at ``MOST`` times its source, and what is over is shared by weight again.
A source's quota of slots is what fills its target to the word (the last slot may be cut).

Every output shard draws its counts of slots per source from a multinomial law on condition
that the sources' totals are their quotas: all slots are dealt to the shards' places by one
pseudorandom permutation. A source's slots, numbered through the shards, go round its
blocks once an epoch, by a pseudorandom permutation of the source and epoch, and are joined
to the blocks by index. The draws depend on nothing but the input rows, so reruns agree.

No group meets in one task: the stream positions are running sums inside hashed parts of
about ``PART`` rows a source, plus the sums before these parts. Only tables with one row a
source, or a source and part, are ordered as a whole.

Edge cases: a null or blank text has size 0 and is never taken. A null source is a source
of its own, the last. Rows that repeat an id are documents of their own; rows that are
equal in all of id, source and size are alike to the mix. Other columns are kept by
``mix``. An empty table, and one without words, give targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 128
SHARD = 1024  # slots of an output shard
CHUNK = 8192  # slots that one row unfolds to
PART = 1000
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Place of x in a pseudorandom permutation of 0 .. n - 1 named by ``key``.

    Four Feistel rounds on a square of at least n cells; a place past n is walked on. The
    square has fewer than 2 sqrt(n) + 1 cells too many, so 64 steps end all walks if n is
    below 900 and all but one in 10**80 beyond.
    """
    side = F.ceil(F.sqrt(n.cast("double")))

    def rounds(v: Column) -> Column:
        left, right = _div(v, side), F.pmod(v, side)
        for k in range(4):
            turn = F.pmod(F.xxhash64(right, F.lit(k), F.lit(SEED), *key), side)
            left, right = right, F.pmod(left + turn, side)
        return left * side + right

    first = rounds(x)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), first,
                         lambda v, _: F.when(v < n, v).otherwise(rounds(v)))
    return F.when(first < n, first).otherwise(walked)


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every row, and its hashed part."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("text").alias("tie")), "mix-sizes")
    parts = rows.count() // PART + 1
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "tie", F.lit(SEED)), F.lit(parts)))


def _targets(parts: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row a source: number, size, target, quota of words, blocks, slots, first slot."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    sources = sources.withColumn("sid", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)),
                               (F.col("sid") - 1) % len(weights) + 1).cast("double"))
    # in the order in which growing shares meet their limits
    limit = MOST * F.col("source_size")
    by_limit = Window.orderBy(limit / F.col("weight"), "sid")
    before, everything = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    none = F.lit(0.0)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), none))
             / (F.sum("weight").over(everything)
                - F.coalesce(F.sum("weight").over(before), none)))
    full = F.col("full")
    shared = (
        sources.withColumn("full", limit / F.col("weight") < level)
        .withColumn("left", F.sum("source_size").over(everything)
                    - F.coalesce(F.sum(F.when(full, limit)).over(everything), none))
        .withColumn("level", F.col("left") / F.sum(F.when(~full, F.col("weight"))).over(everything))
        .withColumn("target", F.when(full, limit.cast("double"))
                    .otherwise(F.least(F.col("level") * F.col("weight"), limit.cast("double")))))
    size, rest = F.col("source_size"), F.col("rest")
    return (
        shared.withColumn("quota", F.least(F.floor(F.col("target") + 0.5), limit))
        .withColumn("whole", _div(size, BLOCK))  # blocks of full length
        .withColumn("blocks", F.col("whole") + F.when(size % BLOCK > 0, 1).otherwise(0))
        .withColumn("rest", F.when(size > 0, F.col("quota") % size).otherwise(0))
        .withColumn("slots", F.when(size > 0, _div(F.col("quota"), size) * F.col("blocks")
                                    + F.ceil(rest / BLOCK)).otherwise(0).cast("long"))
        .withColumn("cut", F.when(rest > 0, rest - (F.ceil(rest / BLOCK) - 1) * BLOCK))
        .withColumn("base", F.coalesce(F.sum("slots").over(
            Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("all_slots", F.sum("slots").over(everything))
        .select("source", "sid", "source_size", "target", "whole", "blocks", "slots", "cut",
                "base", "all_slots"))


def _unfold(rows: DataFrame, first: Column, n: Column, name: str) -> DataFrame:
    """A row for each of first .. first + n - 1, dealt out again in between."""
    chunks = rows.where(n > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), _div(n - 1, CHUNK))))
    lo = first + F.col("chunk") * CHUNK
    hi = F.least(lo + CHUNK, first + n) - 1
    return (chunks.repartition("sid", "chunk", F.xxhash64(first))
            .withColumn(name, F.explode(F.sequence(lo, hi))).drop("chunk"))


def draws(targets: DataFrame) -> DataFrame:
    """Slots that each output shard draws from each source: sid, shard, drawn, and the first
    of the source's slots that they are."""
    slots = _unfold(targets, F.lit(0).cast("long"), F.col("slots"), "slot")
    place = permuted(F.col("base") + F.col("slot"), F.col("all_slots"), F.lit("places"))
    counts = (slots.select("sid", _div(place, SHARD).alias("shard"))
              .groupBy("sid", "shard").agg(F.count("*").alias("drawn")))
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("drawn").over(earlier), F.lit(0)))


def slots(targets: DataFrame) -> DataFrame:
    """All slots of the mix: shard, sid, block, and the words taken if the slot is cut."""
    drawn = draws(targets).join(targets, "sid")
    each = _unfold(drawn, F.col("first"), F.col("drawn"), "slot")
    number, epoch = F.pmod("slot", "blocks"), _div(F.col("slot"), F.col("blocks"))
    # the short block closes an epoch; the others are visited in the epoch's own order
    block = F.when(number < F.col("whole"),
                   permuted(number, F.greatest("whole", F.lit(1)), F.col("sid"), epoch)
                   ).otherwise(F.col("whole"))
    return each.select("shard", "sid", block.alias("block"),
                       F.when(F.col("slot") == F.col("slots") - 1, F.col("cut")).alias("cut"))


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, tie, size, source_size, target, taken for each row of ``docs``."""
    rows = _sizes(docs)
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = stored(_targets(parts, weights), "mix-targets")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    known = targets.select(F.col("source").alias("name"), "sid", "source_size", "target")
    starts = starts.join(known, F.col("source").eqNullSafe(F.col("name"))).select(
        F.col("source").alias("name"), F.col("part").alias("of"), "part_start", "sid",
        "source_size", "target")
    inside = Window.partitionBy("source", "part").orderBy("doc_id", "size", "tie").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = stored(
        rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("name")) & (F.col("part") == F.col("of")))
        .withColumn("start", F.col("part_start") + F.col("before"))
        .select("doc_id", "source", "tie", "size", "source_size", "target", "sid", "start"),
        "mix-placed")

    uses = slots(targets).groupBy("sid", "block").agg(
        F.count(F.when(F.col("cut").isNull(), 1)).alias("times"), F.max("cut").alias("cut"))
    end = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").select(
        "sid", "start", end.alias("end"),
        F.explode(F.sequence(_div(F.col("start"), BLOCK), _div(end - 1, BLOCK))).alias("block"))
    lo = F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0))
    hi = F.least(F.col("end") - F.col("block") * BLOCK, F.lit(BLOCK))
    words = F.col("times") * (hi - lo) + F.greatest(
        F.least(hi, F.coalesce("cut", F.lit(0))) - lo, F.lit(0))
    got = (pieces.join(uses, ["sid", "block"])
           .groupBy("sid", "start").agg(F.sum(words).alias("words")))
    return placed.join(got, ["sid", "start"], "left").select(
        "doc_id", "source", "tie", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.coalesce("words", F.lit(0))).otherwise(0)
        .cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``docs`` with all its columns, each row as often as the mix takes it.

    The number of times is taken / size, rounded up or down by a hash of the row so that
    the words expected are those taken; it is at most ``MOST``.
    """
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    doc_id, source, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "source", "text"))
    rows = taken(docs, weights).where("taken > 0").groupBy("doc_id", "source", "tie").agg(
        (F.sum("taken") / F.sum("size")).alias("share"))
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.col("tie"), F.lit("times")), F.lit(1 << 20))
    rows = rows.withColumn("times", F.floor(F.col("share") + chance / (1 << 20)).cast("int")).where(
        "times > 0")
    together = plain.join(rows, doc_id.cast("long").eqNullSafe(F.col("doc_id"))
                          & source.cast("string").eqNullSafe(F.col("source"))
                          & (F.xxhash64(text) == F.col("tie")))
    return (together.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
            .select(*plain.columns).toDF(*docs.columns))
