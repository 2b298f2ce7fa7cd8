"""N-gram Jaccard join by chosen paths.

A text is the set of its shingles of five words (runs of digits, letters a-z after
lower-casing, and non-ASCII characters); a text of fewer words is one shingle. Equal sets
are one text from here on. In each of ``RUNS`` runs a set descends a random tree: at a node
it goes on with every shingle whose hash there is below 1 / (0.8 * size), so two sets go
the same way where they choose a shared shingle. After ``DEPTH`` levels the sets of a node
are a bucket. A pair at the threshold meets in one run with probability 0.44 (equal sizes)
to 0.37 (one set holds the other), so ``RUNS`` runs miss it with probability 0.0001 to
0.0006: the target recall is 0.999.

Inside a bucket, sketches of 256 bits tell which pairs may be similar; their bars leave
four standard deviations. Sets of fewer than ``SHORT`` shingles would fill too few of the
256 bins, so their bits come from 256 independent hashes, and their bars leave five. The smallest text of a bucket is compared with all; texts surely
near it are settled, since what is similar to them lies in its reach. After two such rounds
the rest are compared with one another; a bucket in which many are left is split on two
more levels first, again and again, each time by ``AGAIN`` independent trees: a pair at the
threshold parts in all of them with probability 0.001 (equal sizes) to 0.003. The pairs found make clusters. In a cluster, whole sets
are compared exactly: all pairs, in tiles of bounded size, so every link between different
texts is counted, and each tile gives back degrees and a spanning forest, never its pairs.

Edge cases: null texts and texts without words have no shingles and no links, and each such
row is a class of its own. Rows with equal sets share a class; ``n_links`` counts other
sets, not copies. A null id takes part; the class of texts without any id is null. Other
columns are ignored by ``classes`` and kept by ``deduplicate``. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import partitions, stored
from marketlens.llm.text import LOWER, Hasher, mix, powers, ragged, slices, utf8, words

SHINGLE = 5
SIMILAR = 0.8
DEPTH = 3
RUNS = 16
SIGNATURE = 256  # bits
SHORT = 256  # shingles below which a pair is compared by independent hashes
CROWD = 5000  # square root of the pairs from which a bucket is split further: fewer sketch
# comparisons cost less than another pass over the texts
AGAIN = 8  # independent trees by which a crowded bucket is split
TILE = 1024  # texts of one side of an exact comparison
SLICE = 300_000
_C = 0x9E3779B97F4A7C15
_K1, _K2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, hasher: Hasher,
                 width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the number of each row."""
    start, end, row = words(data, bounds)
    hashes = hasher.ranges(hasher.running(data), start, end)
    n = len(bounds) - 1
    edges = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(edges)
    rolled, factor = np.zeros(len(hashes), np.uint64), powers(_C, width)
    for k in range(width):  # a text of fewer words is one shingle: the missing words are 0
        rolled[:len(hashes) - k] += hashes[k:] * factor[k]
    made = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    short = np.flatnonzero((count > 0) & (count < width))
    for r in short:
        own = hashes[edges[r]:edges[r + 1]]
        rolled[edges[r]] = (own * factor[:len(own)]).sum(dtype=np.uint64)
    owner = np.repeat(np.arange(n), made)
    value = mix(rolled[ragged(edges[:-1], made)])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.bincount(owner[fresh], minlength=n)


def descend(values: np.ndarray, size: np.ndarray, row: np.ndarray, node: np.ndarray,
            levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and nodes ``levels`` below the given nodes of the given rows."""
    first = np.cumsum(size) - size
    limit = 1.0 / (SIMILAR * np.maximum(size, 1))
    bar = (np.minimum(limit, 1.0) * float((1 << 63) - 1024)).astype(np.uint64)
    for _ in range(levels):
        at = ragged(first[row], size[row])
        parent = np.repeat(np.arange(len(row)), size[row])
        h = (values[at] ^ node[parent]) * _K1
        h ^= h >> np.uint64(32)
        h *= _K2
        chosen = np.flatnonzero((h >> np.uint64(1)) < bar[row[parent]])
        parent, token = parent[chosen], values[at[chosen]]
        node, row = mix(node[parent] * _K2 + token), row[parent]
    return row, node


def all_paths(values: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.flatnonzero(size > 0)
    got = [descend(values, size, rows, np.full(len(rows), mix(np.array([run + 1], np.uint64))[0]),
                   DEPTH) for run in range(RUNS)]
    return np.concatenate([r for r, _ in got]), np.concatenate([p for _, p in got])


def identities(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """16 bytes that name each set."""
    ends = np.cumsum(size)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)])
            for v in (mix(values), mix(values * _K1 + _K2))]
    return np.stack([s[ends] - s[ends - size] for s in sums], 1)


def sketches(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One bit of the least hash in each of 256 bins; an empty bin takes the next one's."""
    n, owner = len(size), np.repeat(np.arange(len(size)), size)
    h = mix(values * _K2 + _K1)
    cell = owner * SIGNATURE + (h >> np.uint64(56)).astype(np.int64)
    order = np.lexsort((h, cell))
    cell, h = cell[order], h[order]
    fresh = np.ones(len(cell), bool)
    fresh[1:] = cell[1:] != cell[:-1]
    bits = np.full(n * SIGNATURE, 2, np.uint8)
    bits[cell[fresh]] = (h[fresh] & np.uint64(1)).astype(np.uint8)
    bits = np.concatenate([bits.reshape(n, SIGNATURE)] * 2, 1)
    at = np.where(bits < 2, np.arange(2 * SIGNATURE), 2 * SIGNATURE - 1)
    at = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1][:, :SIGNATURE]
    filled = np.take_along_axis(bits, at, 1) & 1
    # a borrowed bit is turned by the distance, so that empty stretches do not agree by chance
    filled ^= ((at - np.arange(SIGNATURE)) & 1).astype(np.uint8)
    return np.packbits(filled, 1).view(np.int64)


def independent(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One bit of the least hash by each of 256 functions; no set may be empty."""
    first = np.cumsum(size) - size
    bits = np.empty((len(size), SIGNATURE), np.uint8)
    for k, seed in enumerate(mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * _K2)):
        h = (values ^ seed) * _K1
        h ^= h >> np.uint64(32)
        h *= _K2
        bits[:, k] = (np.minimum.reduceat(h, first) >> np.uint64(20)) & np.uint64(1)
    return np.packbits(bits, 1).view(np.int64)


def all_bits(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """Bits by bins of the sets from ``SHORT`` on, then independent ones of all sets that are
    short or may be similar to a short one."""
    parts = []
    for rows, make in ((np.flatnonzero((size >= SHORT) | (size == 0)), sketches),
                       (np.flatnonzero((size > 0) & (size < SHORT / SIMILAR)), independent)):
        if len(rows):
            at = ragged((np.cumsum(size) - size)[rows], size[rows])
            bits = make(values[at], size[rows])
            parts.append((np.repeat(rows, bits.shape[1]), bits.ravel()))
    row, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    return _lists(row, value, len(size))


def _lists(row: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(row, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(value[order].view(np.int64)))


def _sets(batch: pa.RecordBatch, hasher: Hasher) -> Iterator[tuple]:
    data, bounds = utf8(batch.column("text"))
    for lo, hi in slices(bounds, SLICE):
        own = LOWER[data[bounds[lo]:bounds[hi]]]
        yield batch.slice(lo, hi - lo), *shingle_sets(own, bounds[lo:hi + 1] - bounds[lo], hasher)


def _keys(values: np.ndarray, size: np.ndarray) -> pa.Array:
    names = identities(values, size)
    raw = names.tobytes()
    return pa.array([raw[16 * k:16 * k + 16] if size[k] else None for k in range(len(size))],
                    pa.binary())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for part, values, size in _sets(batch, hasher):
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "tie": part.column("tie"), "key": _keys(values, size),
                "n": pa.array(size, pa.int64()),
                "bits": all_bits(values, size),
                "paths": _lists(*all_paths(values, size), len(size))})


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for part, values, size in _sets(batch, hasher):
            nodes = part.column("paths")
            count = np.diff(nodes.offsets.to_numpy())
            node = nodes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            start = np.repeat(np.arange(len(size)), count)
            got = [descend(values, size, start, mix(node * _K2 + np.uint64(tree + 1)), 2)
                   for tree in range(AGAIN)]
            row, path = (np.concatenate(x) for x in zip(*got, strict=True))
            yield pa.record_batch({"key": _keys(values, size),
                                   "paths": _lists(row, path, len(size))})


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for part, values, size in _sets(batch, hasher):
            yield pa.record_batch({
                "key": _keys(values, size),
                "shingles": _lists(np.repeat(np.arange(len(size)), size), values, len(size))})


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text a key: the wanted columns (key, id and tie among them) beside the text. Rows
    without id, or that repeat one, are told apart by tie, the hash of their text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), _tie(F.col("text")).alias("_tie"), "text")
    return rows.join(wanted.hint("merge"), F.col("_id").eqNullSafe(F.col("id"))
                     & (F.col("_tie") == F.col("tie")))


def _alike(other: str) -> Column:
    """Estimated similarity of a row and the sketch in ``other``: by the last words of both if
    one is short (sizes that do not fit are not alike), else by the first."""
    long, width = F.least("n", f"{other}.n") >= SHORT, SIGNATURE // 64

    def word(bits: Column, k: int) -> Column:
        return F.get(bits, F.when(long, k).otherwise(F.size(bits) - width + k))

    apart = sum(F.bit_count(word(F.col("bits"), k).bitwiseXOR(word(F.col(f"{other}.bits"), k)))
                for k in range(width))
    return 1 - 2 * apart / SIGNATURE


def _slack(n: Column, at: float) -> Column:
    """Four (short sets: five) standard deviations of the estimate for sets of n shingles that
    are similar by ``at``."""
    return F.when(n < SHORT, 5 * ((1 - at * at) / SIGNATURE) ** 0.5).otherwise(
        4 * F.sqrt(0.16 * (2 / SIGNATURE + 1 / n)))


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) >= SIMILAR * F.greatest(a, b)


def _round(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with the first text of each bucket, and the rows that it does not settle."""
    lead = rows.groupBy("path").agg(F.min(F.struct("id", "key", "n", "bits")).alias("lead"),
                                    F.count("*").alias("crowd")).where("crowd > 1")
    least, alike = F.least("n", "lead.n"), _alike("lead")
    near = rows.join(lead, "path").where("key <> lead.key").withColumn("alike", alike)
    pairs = near.where(F.col("alike") >= 0.49 - _slack(least, 0.49)).select(
        "key", F.col("lead.key").alias("other"))
    rest = near.where(F.col("alike") < 0.69 + _slack(least, 0.69)).select("path", "key", "id", "n", "bits")
    return pairs, rest


def _mixed(rest: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the cluster of their text, of the buckets that hold more than one cluster."""
    known = rest.select("path", "key", "id", "n", "bits").join(
        labels.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "label", F.coalesce("label", "key"))
    paths = known.groupBy("path").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(
        "lo <> hi").select("path")
    return known.join(paths, "path", "left_semi")


def _counted(rest: DataFrame) -> DataFrame:
    """Per bucket its largest cluster, and how many pairs of rows lie in different clusters."""
    sizes = rest.groupBy("path", "label").agg(F.count("*").cast("double").alias("c"))
    return sizes.groupBy("path").agg(
        F.max(F.struct("c", "label")).alias("largest"),
        (F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("apart"))


def _crowded(docs: DataFrame, texts: DataFrame, rest: DataFrame, labels: DataFrame) -> DataFrame:
    """``rest``, labelled, with the buckets that are still crowded split on further levels."""
    rest = stored(_mixed(rest, labels), "rest")
    for _ in range(4):
        big = _counted(rest).where(F.col("apart") > CROWD * CROWD).select("path")
        if not big.take(1):
            break
        over = rest.join(big, "path", "left_semi")
        known = over.groupBy("key").agg(F.collect_set("path").alias("paths"),
                                        F.first(F.struct("id", "n", "bits")).alias("own"))
        wanted = known.select("key", "paths").join(texts.select("key", "id", "tie"), "key").select(
            F.col("key").alias("known"), "id", "tie", "paths")
        split = _texts_of(docs, wanted).select("text", "paths").mapInArrow(
            _deeper, "key binary, paths array<long>")
        again = split.select("key", F.explode("paths").alias("path")).distinct().join(
            known.select("key", "own.*"), "key").select("path", "key", "id", "n", "bits")
        rest = rest.select("path", "key", "id", "n", "bits")
        rest = rest.join(big, "path", "left_anti").unionByName(again)
        rest = stored(_mixed(rest, labels), "rest")
    return rest


def components(edges: DataFrame) -> DataFrame:
    """node and label (least node of its component) for edges a, b."""
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct(), "edges")
    labels = stored(both.groupBy("node").agg(
        F.least(F.col("node"), F.min("to")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy(
            "node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stored(step.join(jump, "label").select(
            "node", F.least("label", "far").alias("label"), "was"), "labels")
        labels = new.select("node", "label")
        if not new.where("label <> was").take(1):
            return labels


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of left and right are similar, exactly."""
    size = np.array([len(s) for s in sets])
    token, code = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(code, minlength=len(token)) > 1
    column = np.cumsum(often) - 1
    owner, keep = np.repeat(np.arange(len(sets)), size), often[code]
    owner, code = owner[keep], column[code[keep]]
    shared = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for lo in range(0, int(often.sum()), 2048):
        a, b = np.searchsorted(code, [lo, lo + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[owner[a:b], code[a:b] - lo] = 1
        shared += part[left] @ part[right].T
    return shared >= SIMILAR * (size[left][:, None] + size[right][None, :] - shared)


def _compare(members: list[tuple]) -> pa.RecordBatch | None:
    """Degrees of, and forest edges between, the texts of one tile: (key, side, shingles)."""
    keys = [k for k, _, _ in members]
    sets = [np.asarray(s) for _, _, s in members]
    side = np.array([s for _, s, _ in members])
    one = not side.any()
    left = np.arange(len(keys)) if one else np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return None
    links = _links(sets, left, right)
    if one:
        np.fill_diagonal(links, False)
    degree = np.zeros(len(keys), np.int64)
    degree[left] += links.sum(1)
    if not one:
        degree[right] += links.sum(0)
    root = np.full(len(keys), -1)
    for start in range(len(left)):
        if root[left[start]] >= 0:
            continue
        near = np.zeros(len(left), bool)
        near[start] = True
        reach = np.zeros(len(right), bool)
        while True:
            far = links[near].any(0)
            back = links[:, far].any(1) | near if far.any() else near
            if (far == reach).all() and (back == near).all():
                break
            reach, near = far, back
        root[left[near]] = root[right[reach]] = left[start]
    linked = np.flatnonzero(degree > 0)
    return pa.record_batch({
        "key": pa.array([keys[k] for k in linked], pa.binary()),
        "other": pa.array([keys[root[k]] for k in linked], pa.binary()),
        "degree": pa.array(degree[linked])})


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one tile are compared with one another."""
    tile, members = None, []
    for batch in batches:
        names = zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j", "key", "side")),
                    strict=True)
        lists = batch.column("shingles")
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for k, (cluster, i, j, key, side) in enumerate(names):
            if (cluster, i, j) != tile:
                out = _compare(members) if len(members) > 1 else None
                if out is not None:
                    yield out
                tile, members = (cluster, i, j), []
            members.append((key, side, flat[ends[k]:ends[k + 1]].copy()))
    out = _compare(members) if len(members) > 1 else None
    if out is not None:
        yield out


def _verified(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """key, other, degree out of the exact comparisons inside clusters (key, id, cluster)."""
    count = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    placed = clusters.join(count, "cluster").withColumn(
        "tile", F.pmod(F.xxhash64("key"), F.col("tiles")))
    wanted = placed.select(F.col("key").alias("known"), "id", "tie")
    sets = _texts_of(docs, wanted).select("text").mapInArrow(
        _whole_sets, "key binary, shingles array<long>").dropDuplicates(["key"])
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("mate")
    rows = sets.join(placed, "key").select("key", "shingles", "cluster", "tile", other).select(
        "key", "shingles", "cluster", F.least("tile", "mate").alias("i"),
        F.greatest("tile", "mate").alias("j"),
        F.when(F.col("tile") > F.col("mate"), 1).otherwise(0).alias("side"))
    return (rows.repartition(partitions(docs.sparkSession), "cluster", "i", "j")
            .sortWithinPartitions("cluster", "i", "j")
            .mapInArrow(_tiles, "key binary, other binary, degree long"))


def _tie(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_rows, n_links, n_shingles for each row of ``docs``.

    ``class_id`` is the least id among the rows that are linked, directly or through others;
    ``n_links`` is the number of different texts to which the row's text is linked.
    """
    return _classes(docs).drop("tie")


def _classes(docs: DataFrame) -> DataFrame:
    """The columns of ``classes``, and tie (hash of the text)."""
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tie(F.col("text")).alias("tie"),
                              "text").mapInArrow(
        _scan, "doc_id long, tie long, key binary, n long, bits array<long>, paths array<long>"), "sets")
    filled = rows.where("key IS NOT NULL")
    texts = filled.groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("least"), F.count("*").alias("rows"))
    texts = stored(texts.select("key", F.col("least.doc_id").alias("id"), "least.tie", "rows"), "texts")
    single = stored(filled.select("key", "n", "bits", "paths").dropDuplicates(["key"]), "single")
    shared = single.select(F.explode("paths").alias("path")).groupBy("path").count().where(
        "count > 1").select("path")
    meeting = single.select(F.explode("paths").alias("path"), "key").join(
        shared, "path", "left_semi").distinct()
    about = single.select("key", "n", "bits").join(texts.select("key", "id"), "key")
    members = stored(meeting.join(about, "key").select("path", "key", "id", "n", "bits"), "buckets")

    first, rest = _round(members)
    rest = stored(rest, "rest")
    second, rest = _round(rest)
    led = stored(first.unionByName(second).distinct(), "pairs")
    # what two texts of one cluster share is settled in the cluster
    labels = components(led.select(F.col("key").alias("a"), F.col("other").alias("b")))
    rest = _crowded(docs, texts, rest, labels)
    # the largest cluster of a bucket meets the others, which meet one another as well
    fewer = rest.join(_counted(rest).select("path", "largest.label"), ["path", "label"], "left_anti")
    mate = rest.select("path", F.struct("key", "label", "n", "bits").alias("mate"))
    third = fewer.join(mate, "path").where(
        (F.col("label") != F.col("mate.label"))
        & _sizes_fit(F.col("n"), F.col("mate.n"))
        & (_alike("mate") >= SIMILAR - _slack(F.least("n", "mate.n"), SIMILAR))).select(
        F.col("label").alias("a"), F.col("mate.label").alias("b"))
    over = components(third.distinct())
    found = labels.select("node").union(third.select("a")).union(third.select("b")).distinct()
    clusters = (found.join(labels, "node", "left")
                .withColumn("label", F.coalesce("label", "node"))
                .join(over.select(F.col("node").alias("label"), F.col("label").alias("whole")),
                      "label", "left")
                .select("node", F.coalesce("whole", "label").alias("cluster")))
    clusters = stored(clusters.join(texts, clusters["node"] == texts["key"]).select(
        "key", "id", "tie", "cluster"), "clusters")

    links = stored(_verified(docs, clusters), "links")
    degrees = links.groupBy("key").agg(F.sum("degree").alias("n_links"))
    joined = components(links.where("key <> other").select(
        F.col("key").alias("a"), F.col("other").alias("b")))
    known = texts.join(joined, texts["key"] == joined["node"], "left").join(
        degrees, "key", "left").select(
        "key", "id", "rows", F.coalesce("label", "key").alias("label"), "n_links")
    whole = known.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("rows").alias("class_rows"))
    per_text = stored(known.join(whole, "label").select(
        "key", "class_id", "class_rows", "n_links"), "classes")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "tie", "key", "n").join(per_text, "key", "left").select(
        "doc_id", "tie", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
        .alias("class_id"), F.coalesce("class_rows", F.lit(1).cast("long")).alias("class_rows"),
        F.coalesce("n_links", zero).alias("n_links"), F.col("n").alias("n_shingles"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, less the rows whose class another row stands for.

    The row with the least id of a class stays. Rows without shingles or without id stay,
    and so do rows whose id is that of their class. Rows that repeat an id with another text
    are decided on their own.
    """
    gone = _classes(docs).where("doc_id <> class_id").select(
        F.col("doc_id").alias("_gone"), F.col("tie").alias("_gone_tie")).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["_gone"])
                     & (_tie(docs["text"]) == gone["_gone_tie"]), "left_anti")
