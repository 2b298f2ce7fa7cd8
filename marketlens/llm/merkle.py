"""Merkle manifest of a dataset, with inclusion proofs by content-addressed descent.

Each row is a leaf, the digest of its fields. The leaves of a source ascend by id and form
a tree of ``FAN`` children a node; the sources' roots, in the order of the sources, form one
more tree. Every inner node is stored as a record *digest -> children*, so a record can be
found by its content alone. Requests for leaves descend from the root: at each step the
requests that share a prefix are one row, the record of its digest is looked up, the next
digit of the rank selects a child, and the children not selected are collected. The path
read backwards is the proof.

Ranks come from a range partition of all rows by source, id and digest, the position
inside the partition, and prefix sums over partitions; no source is ever ordered in one task.
A parent gathers at most ``FAN`` digests. Each step of the descent has one row for 16 of the
next, and the last step meets the requests grouped by parent, so that paths are shuffled
once for 16 leaves.

Edge cases: a null field is written ``-``, so it differs from an empty one. A null source is
a source of its own and comes first. Rows without id come first in their source and are never
tampered with. Rows that repeat an id are ordered by digest; equal rows are leaves of their
own with equal digests, and share records. Other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import partitions, stored

FAN = 16
BITS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LOCAL = 33  # bits of a row's position in its partition
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts), 256)


def together(children: Column) -> Column:
    return F.array_join(children, "")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and ``other``: the leaf of the text without capitals where the
    checksum of the id is a multiple of 5."""
    doc_id = F.col("doc_id").cast("long")
    values = {"doc_id": doc_id, "n_chars": F.col("n_chars").cast("long"),
              **{c: F.col(c).cast("string") for c in ("source", "lang", "text")}}
    row = [written(values[c]) for c in FIELDS]
    low = [*row[:-1], written(F.translate(values["text"], UPPER, LOWER))]
    chosen = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select(
        doc_id.alias("doc_id"), values["source"].alias("source"), digest(*row).alias("leaf"),
        F.when(chosen, digest(*low)).alias("other"))


def ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves with ``sid``, the number of the source, and ``at``, the rank in it; and the
    sources: sid, n."""
    spark, keys = rows.sparkSession, ("source", "doc_id", "leaf", "salt")
    # the salt lets equal rows of any number spread over partitions
    placed = stored(
        stored(rows, "merkle-leaves").withColumn("salt", F.monotonically_increasing_id())
        .repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).drop("salt")
        .withColumn("place", F.monotonically_increasing_id()), "merkle-placed")
    part = F.shiftright("place", LOCAL)
    pieces = placed.groupBy("source", part.alias("part")).agg(
        F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))

    # number of a source: those that begin in earlier partitions, and earlier in its own
    sources = pieces.groupBy("source").agg(F.min("first").alias("first"), F.sum("n").alias("size"))
    sources = sources.withColumn("begins", F.shiftright("first", LOCAL))
    begun = sources.groupBy("begins").agg(F.count("*").alias("k")).withColumn(
        "earlier", F.coalesce(F.sum("k").over(  # a row a partition
            Window.orderBy("begins").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("begins").orderBy("first")) - 1
    sources = stored(
        sources.withColumn("inside", inside).join(begun, "begins").select(
            "source", (F.col("earlier") + F.col("inside")).alias("sid"), "size"), "merkle-sources")

    named = sources.select(F.col("source").alias("name"), "sid", "size")
    pieces = pieces.join(named, F.col("source").eqNullSafe(F.col("name"))).select(
        "name", F.col("part").alias("of"), "first", "offset", "sid")
    out = (placed.withColumn("part", part)
           .join(pieces, (F.col("part") == F.col("of")) & F.col("source").eqNullSafe(F.col("name")))
           .select("sid", (F.col("offset") + F.col("place") - F.col("first")).alias("at"),
                   "doc_id", "leaf", "other"))
    return stored(out, "merkle-ranked"), sources.select("sid", F.col("size").alias("n"))


def height(n: Column | int):
    """Levels above ``n`` nodes until one remains."""
    if isinstance(n, int):
        return 0 if n < 2 else 1 + height(-(-n // FAN))
    # (n - 1) in hexadecimal has as many digits as the tree has levels
    return F.when(n < 2, 0).otherwise(F.length(F.hex(n - 1)))


def grow(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Records of the trees over ``nodes`` (tree, at, n, digest), and the roots (tree, digest)."""
    records, roots = [], [nodes.where("n = 1").select("tree", "digest")]
    for _ in range(levels):
        child = F.array_sort(F.collect_list(F.struct("at", "digest")))["digest"]
        above = stored(
            nodes.where("n > 1").groupBy("tree", F.shiftright("at", BITS).alias("up"))
            .agg(child.alias("children"), F.first("n").alias("n"))
            .select("tree", F.col("up").alias("at"), F.ceil(F.col("n") / FAN).alias("n"),
                    digest(together(F.col("children"))).alias("digest"), "children"),
            "merkle-level")
        records.append(above.select("digest", "children"))
        nodes = above.drop("children")
        roots.append(nodes.where("n = 1").select("tree", "digest"))
    return records, reduce(DataFrame.unionByName, roots)


def step(front: DataFrame, manifest: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The next nodes on the way to the requests: each record's children are selected by the
    digit ``asked`` for, and the others join the path."""
    found = front.join(manifest, "digest").withColumn(
        "below", F.explode(F.sequence(F.lit(0), F.size("children") - 1)))
    digit = F.col("below")
    segment = F.struct(
        together(F.slice("children", F.lit(1), digit)).alias("left"),
        together(F.slice("children", digit + 2, F.lit(FAN))).alias("right"))
    moved = (found.withColumn("path", F.concat(F.col("path"), F.array(segment)))
             .withColumn("digest", F.get("children", digit))
             .withColumn("at", F.col("at") * FAN + digit).drop("children", "below"))
    return moved.join(asked, keys, "left_semi")


def proofs(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, leaf, other, subroot, root and the proof of each leaf of ``docs``, or of those
    whose id is in ``wanted``.

    ``proof`` has a segment a level, from the leaf up: the digests to the left and to the
    right of the node in its record.
    """
    rows, sources = ranked(leaves(docs))
    size = sources.agg(F.count("*").alias("k"), F.max("n").alias("most")).first()
    top, deep = height(size["k"]), height(size["most"] or 0)

    records, subroots = grow(rows.join(sources, "sid").select(
        F.col("sid").alias("tree"), "at", "n", F.col("leaf").alias("digest")), deep)
    upper, roots = grow(subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"),
        F.lit(size["k"]).cast("long").alias("n"), "digest"), top)
    found = [*records, *upper]
    manifest = stored(reduce(DataFrame.unionByName, found).dropDuplicates(["digest"]),
                      "merkle-manifest") if found else None

    requests = rows
    if wanted is not None:
        requests = rows.join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id",
                             "left_semi")
    leaf = F.struct((F.col("at") % FAN).cast("int").alias("digit"), "doc_id", "leaf", "other")
    grouped = stored(
        requests.groupBy("sid", F.shiftright("at", BITS).alias("at"))
        .agg(F.collect_list(leaf).alias("leaves")), "merkle-requests")

    # down the tree of the sources
    empty = F.array().cast("array<struct<left:string,right:string>>")
    front = roots.select("digest", F.col("digest").alias("root"), empty.alias("path"),
                         F.lit(0).cast("long").alias("at"))
    sids = grouped.select("sid").distinct()
    for level in reversed(range(top)):
        front = step(front, manifest, sids.select(
            F.shiftright("sid", BITS * level).alias("at")).distinct(), ["at"])
    levels = sources.select("sid", height(F.col("n")).alias("levels"))
    starts = stored(
        front.withColumnRenamed("at", "sid").join(levels, "sid").select(
            "sid", "digest", F.col("digest").alias("subroot"), "root", "path", "levels",
            F.lit(0).cast("long").alias("at")), "merkle-subroots")

    # down the trees of the sources: higher trees begin earlier
    front = starts.where(F.col("levels") == deep)
    for level in reversed(range(1, deep)):
        asked = grouped.select("sid", F.shiftright("at", BITS * (level - 1)).alias("at")).distinct()
        front = step(front, manifest, asked, ["sid", "at"]).unionByName(
            starts.where(F.col("levels") == level))
    front = front.join(grouped, ["sid", "at"])
    if deep:
        front = front.where("levels > 0").join(manifest, "digest")
        child, own = F.col("children"), F.col("l.digit")
        segment = F.struct(
            together(F.slice(child, F.lit(1), own)).alias("left"),
            together(F.slice(child, own + 2, F.lit(FAN))).alias("right"))
        below = front.withColumn("l", F.explode("leaves")).select(
            "l.doc_id", F.get(child, own).alias("leaf"), "l.other", "subroot", "root",
            F.reverse(F.concat(F.col("path"), F.array(segment))).alias("proof"))
        front = starts.where("levels = 0").join(grouped, ["sid", "at"])
    alone = front.withColumn("l", F.explode("leaves")).select(
        "l.doc_id", F.col("subroot").alias("leaf"), "l.other", "subroot", "root",
        F.reverse("path").alias("proof"))
    return below.unionByName(alone) if deep else alone


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and the segments of its proof."""
    return F.aggregate(proof, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def verify(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row."""
    segments = F.transform("proof", lambda s: F.concat(s["left"], s["right"]))
    return proofs(docs, wanted).select(
        "doc_id", "leaf", "subroot", "root", digest(together(segments)).alias("proof_sha256"),
        folded(F.coalesce("other", "leaf"), F.col("proof")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
