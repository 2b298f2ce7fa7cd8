"""Exact deduplication by content sort.

Texts are compared after deleting ASCII white space. Splitters sampled over a bounded prefix, a
hash and a slice deal the rows out by range, once; inside a partition the external sort puts equal
texts next to each other, and the sorted aggregate compares each text in full with its neighbour
and keeps one row a run. The runs are whole, but for the texts that more rows share than a
partition should hold: their rows carry the number of a slice, so that they spread over
partitions, and only the runs of these slices, one row each, meet again and are compared in full.

The texts that are sliced are found by counting hashes; a collision slices one text more and
changes no result. There are at most eight of them a partition, so their list is broadcast, and
at most sixteen slices a partition in all.

Edge cases: a null text counts as empty, and all empty texts are one group. Rows without
``doc_id`` take part; they are preferred last. Rows that repeat an id are decided each by its own
text; where id and text repeat, the rows share one decision. Other columns of the input are
ignored by ``classes`` and kept by ``deduplicate``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import partitions, stored

BLANK = r"[\x20\x09-\x0D]+"
PREFIX = 32  # code points of a splitter; ties go on by hash and slice


def _text(text: str | Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _normalised(docs: DataFrame) -> DataFrame:
    """Of each row its normalised text, with a hash, and its rank: the longest original first,
    then the smallest id, a null id after all others, then a hash of the original."""
    text = _text("text")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.regexp_replace(text, BLANK, "").alias("norm"),
                        F.length(text).alias("n_chars"), F.xxhash64(text).alias("tie"))
    return named.select(
        "norm", F.xxhash64("norm").alias("hash"),
        F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("tie"))
        .alias("rank"))


def _digest(norm: str) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _slices(rows: DataFrame) -> DataFrame:
    """Hashes of the texts that more rows share than a quarter of a partition's part, with the
    number of slices."""
    part = max(rows.count() // (4 * partitions(rows.sparkSession)), 1)
    counts = rows.groupBy("hash").count()
    return counts.where(F.col("count") > part).select(
        "hash", F.ceil(F.col("count") / part).alias("slices"))


def _groups(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a distinct text: digest, the rank that stays, and the number of rows. ``rows`` has
    the hash of each row of ``docs``."""
    few = F.broadcast(_slices(rows))
    sliced = _normalised(docs).join(few, "hash", "left").select(
        F.substring("norm", 1, PREFIX).alias("prefix"), "hash",
        F.when(F.col("slices").isNull(), -1).otherwise(F.pmod(F.xxhash64("rank"), "slices"))
        .alias("slice"), "norm", "rank")
    place = ["prefix", "hash", "slice"]
    # the range partitioning by ``place`` holds for the aggregate as well: no second exchange
    dealt = sliced.repartitionByRange(partitions(docs.sparkSession), *place)
    runs = dealt.sortWithinPartitions(*place, "norm", "rank").groupBy(*place, "norm").agg(
        F.min("rank").alias("best"), F.count("*").alias("group_size"))
    cut = F.col("slice") >= 0
    runs = stored(runs.select(F.when(~cut, _digest("norm")).alias("digest"),
                              F.when(cut, F.col("norm")).alias("norm"), "best", "group_size"),
                  "exact-runs")
    met = runs.where("norm IS NOT NULL").groupBy("norm").agg(
        F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
    return runs.where("norm IS NULL").drop("norm").unionByName(
        met.select(_digest("norm").alias("digest"), "best", "group_size"))


def _decided(docs: DataFrame) -> DataFrame:
    """The columns of ``classes``, and tie (hash of the original text)."""
    rows = stored(_normalised(docs).select("hash", "rank", _digest("norm").alias("digest")),
                  "exact-rows")
    return rows.join(_groups(docs, rows), "digest").select(
        "rank.doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        F.col("rank").eqNullSafe(F.col("best")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "rank.tie")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    ``kept`` holds for the row that stays; rows that repeat its id and its text share it.
    """
    return _decided(docs).drop("tie")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, less the rows whose text stays in another row."""
    kept = _decided(docs).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_id"])
                     & (F.xxhash64(_text(docs["text"])) == kept["_tie"]), "left_semi")
