"""Line deduplication by content-defined chunks, without Python on the executors.

A text is its lines between line feeds. A hash rolling over the hashes of ``WINDOW`` lines
ends a chunk where it is 0 modulo ``SPACING``, so boundaries depend on the lines near them
alone and move with them. Chunks of at least ``LINES`` lines that occur more than once in
the corpus are removed but for their first occurrence (least id, then position).

Chunks of about ``SPACING`` lines miss short passages, as their ends hold foreign lines. With
``passages``, as the registered query has it, a second set of chunks joins them, which begin
(and, mirrored, end) at every line and are as short as ``LINES`` lines and more than ``WORDS``
words allow. One that also occurs in a document of smaller id is removed. These chunks lie
wholly inside every repeated passage of ``LINES`` lines and more than ``WORDS`` words and
together cover it, so such passages go whole, and a line goes only with a passage that one
earlier document holds in one piece. The first document with a line keeps it.

Texts are cut into lines once; what follows works on the hashes, words and bytes of lines.
Only chunks all whose pairs of lines occur in several documents are made in the second set.
Hashes only propose: chunks that meet the same earlier text side by side are joined to
stretches, and a stretch is removed after its bytes have been compared with the earlier one's.

Counts are combined before they are dealt out by hash, and repeated chunks meet their first
occurrence in a join that can be split, so one chunk may be in any share of the rows. What is
gathered in one row or window is bounded by the lines of one document.

Edge cases: a null text counts as empty, one empty line. Rows equal in id and text count as
one document and share its result. A null id comes last among first occurrences. Other
columns are ignored by ``removals`` and kept by ``deduplicate``. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import stored

WINDOW = 2
SPACING = 4
LINES = 2
WORDS = 50
NONE = "array<struct<start:int,stop:int>>"


def _identity(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(text).alias("tie"), text.alias("text"))


def _same(left: DataFrame, right: DataFrame) -> Column:
    """Equal documents; the right side names them di, dt."""
    return left["doc_id"].eqNullSafe(right["di"]) & (left["tie"] == right["dt"])


def _spans(hashes: Column) -> Column:
    """start and stop (behind the last line) of the chunks between boundaries of the rolling hash."""
    n = F.size(hashes)
    rolled = hashes
    for back in range(1, WINDOW):
        earlier = F.slice(F.concat(F.array_repeat(F.lit(0).cast("long"), back), hashes), 1, n)
        rolled = F.zip_with(rolled, earlier, lambda a, b: F.xxhash64(b, a))
    ends = F.filter(F.transform(rolled, lambda h, i: F.when(F.pmod(h, F.lit(SPACING)) == 0, i + 1)),
                    lambda e: e < n)
    return F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(ends, F.array(n)),
                      lambda a, b: F.struct(a.alias("start"), b.alias("stop")))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, tie (hash of the text), n_bytes, lines (h, g, words, size of each), spans (chunks)."""
    cut = _identity(docs).select("doc_id", "tie", F.octet_length("text").alias("n_bytes"), F.transform(
        F.split("text", "\n", -1), lambda x: F.struct(
            F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"),
            F.regexp_count(x, F.lit(r"\S+")).alias("words"), F.octet_length(x).alias("size"))).alias("lines"))
    return cut.withColumn("spans", _spans(F.col("lines.h")))


def _shared_pairs(cut: DataFrame) -> DataFrame:
    """doc_id, tie, k, a, b (words) of all lines k that, with the next one, several documents hold."""
    pairs = cut.select("doc_id", "tie", F.posexplode(F.zip_with(
        F.slice("lines", 1, F.size("lines") - 1), F.slice("lines", 2, F.size("lines") - 1),
        lambda a, b: F.struct(F.xxhash64(a["h"], b["h"]).alias("pair"), a["words"].alias("a"),
                              b["words"].alias("b")))).alias("k", "p")).select("doc_id", "tie", "k", "p.*")
    whose = F.xxhash64("doc_id", "tie")
    several = (pairs.groupBy("pair").agg(F.min(whose).alias("least"), F.max(whose).alias("most"))
               .where("least <> most").select("pair"))
    return pairs.join(several.hint("merge"), "pair").select("doc_id", "tie", "k", "a", "b")


def _short_spans(cut: DataFrame) -> DataFrame:
    """di, dt, short: the shortest chunks from and to every line inside stretches of shared pairs.

    With c the words before a line, the shortest chunk from line t ends before the first line
    with c >= c(t) + WORDS + 1. Lines and their questions are put in one order, so each question
    finds its answer as the last line passed. Negated places give the chunks that end at a line.
    """
    pairs = _shared_pairs(cut).distinct()
    own = Window.partitionBy("doc_id", "tie")
    runs = pairs.withColumn("run", F.col("k") - F.row_number().over(own.orderBy("k")))
    run = Window.partitionBy("doc_id", "tie", "run")
    before = F.sum("a").over(run.orderBy("k")) - F.col("a")
    runs = runs.select("doc_id", "tie", "run", "k", "a", "b", before.alias("c"),
                       F.min("k").over(run).alias("lo"), (F.max("k").over(run) + 2).alias("hi"))
    runs = runs.withColumn("all", F.max(F.col("c") + F.col("a") + F.col("b")).over(run))
    place = [F.struct(t.alias("t"), c.cast("long").alias("c")) for t, c in (
        (F.col("k"), F.col("c")), (F.col("k") + 1, F.col("c") + F.col("a")),
        (F.col("k") + 2, F.col("c") + F.col("a") + F.col("b")))]
    places = runs.where(F.col("all") > WORDS).select("doc_id", "tie", "run", "lo", "hi", F.explode(
        F.when(F.col("k") + 2 == F.col("hi"), F.array(*place)).otherwise(F.array(place[0]))).alias("p"))
    events = places.select("doc_id", "tie", "run", "lo", "hi", F.explode(F.array(*(
        F.struct(F.lit(sign).alias("sign"), F.lit(asks).alias("asks"), (F.col("p.t") * sign).alias("t"),
                 (F.col("p.c") * sign + asks * (WORDS + 1)).alias("v"))
        for sign in (1, -1) for asks in (0, 1)))).alias("e")).select("doc_id", "tie", "run", "lo", "hi", "e.*")
    passed = Window.partitionBy("doc_id", "tie", "run", "sign").orderBy(
        F.desc("v"), "asks", F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    met = F.last(F.when(F.col("asks") == 0, F.col("t")), ignorenulls=True).over(passed)
    found = events.withColumn("met", met).where("asks = 1 and met is not null").select(
        "doc_id", "tie", "lo", "hi",
        F.when(F.col("sign") == 1, F.col("t")).otherwise(F.least(-F.col("met"), -F.col("t") - LINES)).alias("start"),
        F.when(F.col("sign") == 1, F.greatest("met", F.col("t") + LINES)).otherwise(-F.col("t")).alias("stop"))
    return found.where("start >= lo and stop <= hi").groupBy("doc_id", "tie").agg(
        F.collect_set(F.struct("start", "stop")).alias("short")).withColumnsRenamed({"doc_id": "di", "tie": "dt"})


def _named(cut: DataFrame, passages: bool) -> DataFrame:
    """doc_id, tie, kind (0: between boundaries, 1: short), start, stop, n1, n2 (names) of all chunks."""
    if passages:
        short = _short_spans(cut)
        cut = cut.join(short.hint("merge"), _same(cut, short), "left").withColumn("short", F.coalesce(
            "short", F.array().cast(NONE)))
    else:
        cut = cut.withColumn("short", F.array().cast(NONE))
    h, g = F.col("lines.h"), F.col("lines.g")

    def named(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
            F.xxhash64(F.slice(h, s["start"] + 1, s["stop"] - s["start"])).alias("n1"),
            F.xxhash64(F.slice(g, s["start"] + 1, s["stop"] - s["start"])).alias("n2")))

    long = F.filter("spans", lambda s: s["stop"] - s["start"] >= LINES)
    return cut.select("doc_id", "tie", F.explode(F.concat(named(long, 0), named(F.col("short"), 1))).alias(
        "s")).select("doc_id", "tie", "s.*")


def _proposed(cut: DataFrame, passages: bool) -> DataFrame:
    """doc_id, tie, kind, start, stop, n_chunks, di, dt, ds: stretches and their earlier places."""
    keyed = stored(_named(cut, passages), "line-chunks")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "start")
    name = ["kind", "n1", "n2"]
    firsts = (keyed.groupBy(*name).agg(F.min(place).alias("first"), F.count("*").alias("c"))
              .where("c > 1").select(*name, "first"))
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie")))
    again = (keyed.join(firsts.hint("merge"), name)
             .where(other | ((F.col("kind") == 0) & (F.col("start") > F.col("first.start"))))
             .select("doc_id", "tie", "kind", "start", "stop", F.col("first.doc_id").alias("di"),
                     F.col("first.tie").alias("dt"), (F.col("start") - F.col("first.start")).alias("shift"))
             .distinct())
    side = ["doc_id", "tie", "kind", "di", "dt", "shift"]
    along = Window.partitionBy(*side).orderBy("start", "stop")
    reached = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = again.withColumn("fresh", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    return (fresh.withColumn("part", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*side, "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"),
                                        F.count("*").alias("n_chunks"))
            .select("doc_id", "tie", "kind", "start", "stop", "n_chunks", "di", "dt",
                    (F.col("start") - F.col("shift")).alias("ds")))


def _gone(docs: DataFrame, cut: DataFrame, passages: bool) -> DataFrame:
    """di, dt, n_removed (chunks), gone (lines) of the documents that lose lines."""
    proposed = stored(_proposed(cut, passages), "line-proposed")
    length = F.col("stop") - F.col("start")
    heads = proposed.select("di", "dt", F.struct(F.col("ds").alias("start"), (F.col("ds") + length).alias("stop")
                                                 ).alias("s"))
    wanted = (proposed.select(F.col("doc_id").alias("di"), F.col("tie").alias("dt"),
                              F.struct("start", "stop").alias("s")).union(heads)
              .groupBy("di", "dt").agg(F.collect_set("s").alias("wanted")))
    texts = _identity(docs)
    parts = texts.join(wanted.hint("merge"), _same(texts, wanted)).select(
        "doc_id", "tie", "wanted", F.split("text", "\n", -1).alias("lines"))
    parts = parts.select("doc_id", "tie", F.explode(F.transform("wanted", lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"),
        F.array_join(F.slice("lines", s["start"] + 1, s["stop"] - s["start"]), "\n").alias("bytes")))).alias("p"))
    parts = stored(parts.select("doc_id", "tie", "p.*").dropDuplicates(["doc_id", "tie", "start", "stop"]),
                   "line-bytes")

    def at(prefix: str, doc_id: str, tie: str, start: str) -> tuple[DataFrame, Column]:
        side = parts.toDF(*(f"{prefix}{c}" for c in ("id", "tie", "start", "stop", "bytes")))
        return side, (F.col(doc_id).eqNullSafe(F.col(f"{prefix}id")) & (F.col(tie) == F.col(f"{prefix}tie"))
                      & (F.col(start) == F.col(f"{prefix}start"))
                      & (F.col(start) + length == F.col(f"{prefix}stop")))

    own, here = at("own_", "doc_id", "tie", "start")
    head, there = at("head_", "di", "dt", "ds")
    equal = proposed.join(own.hint("merge"), here).join(head.hint("merge"), there).where("own_bytes = head_bytes")
    return (equal.groupBy("doc_id", "tie").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n_chunks")).otherwise(0)).alias("n_removed"),
        F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("stop") - 1)))).alias("gone"))
        .withColumnsRenamed({"doc_id": "di", "tie": "dt"}))


def removals(docs: DataFrame, passages: bool = False) -> DataFrame:
    """doc_id, n_lines, n_chunks, n_removed (chunks), removed_lines, kept_bytes for each row.

    Chunks are those between boundaries of the rolling hash. With ``passages``, removed_lines
    and kept_bytes count the lines of the short chunks as well.
    """
    cut = stored(lines(docs), "line-hashes")
    gone = _gone(docs, cut, passages)
    zero = F.lit(0).cast("long")
    # what is removed takes one line feed along, unless nothing is left
    sizes = F.aggregate(F.transform("gone", lambda i: F.get(F.col("lines.size"), i)), zero,
                        lambda total, size: total + size + 1)
    return cut.join(gone.hint("merge"), _same(cut, gone), "left").select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("spans").cast("long").alias("n_chunks"),
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce(F.size("gone").cast("long"), zero).alias("removed_lines"),
        F.greatest(F.col("n_bytes") - F.coalesce(sizes, zero), zero).cast("long").alias("kept_bytes"))


def deduplicate(docs: DataFrame, passages: bool = False) -> DataFrame:
    """``docs`` with all its columns; the text without its repeated chunks (and passages)."""
    cut = stored(lines(docs), "line-hashes")
    gone = _gone(docs, cut, passages).select("di", "dt", "gone")
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    out = plain.join(gone, doc_id.cast("long").eqNullSafe(F.col("di"))
                     & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("dt")), "left")
    every = F.split(text, "\n", -1)
    rest = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("gone"))
    clean = F.when(F.col("gone").isNull(), text).otherwise(F.coalesce(
        F.array_join(F.transform(rest, lambda i: F.get(every, i)), "\n"), F.lit("")))
    return out.select(*(clean.alias(c) if docs.columns[k] == "text" else F.col(c)
                        for k, c in enumerate(plain.columns))).toDF(*docs.columns)
