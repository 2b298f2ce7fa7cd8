"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words, a block is two of them. Every window of ``window`` consecutive words
of an item is a pattern, as is a shorter item as a whole. For the patterns of one length m
a shift table tells how far a search may skip given the last block read: m - 1 words if no
pattern holds the block. Where it says 0, the hash of the block picks the bucket of the
patterns that end so, the hash of the whole window picks one of them, and the words are
compared byte by byte. The search runs over many stretches of text side by side.

Documents are never shuffled: each batch is searched where it is read. The items are
gathered in blocks of about ``block_chars`` characters; each block is a pass of its own over
the rows that the previous one has marked and stored.

Edge cases: null, empty and wordless texts have no words and no hits; wordless items match
nothing. Items without ``item_id`` mark words but have no id to report. Repeated items count
once. Equal windows in several items count for each of them. Windows never cross documents.
Other columns are ignored by ``occurrences`` and kept by ``decontaminate``. Without items no
document is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import plain_names, stored
from marketlens.llm.text import LOWER, Hasher, mix, ragged, slices, utf8, words

WINDOW = 10
BLOCK_CHARS = 8_000_000
LANE = 128  # window ends that one lane searches
_C = np.uint64(0x9E3779B97F4A7C15)


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = utf8(column)
    return LOWER[data], bounds


def _block(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends at ``at``."""
    if size == 1:
        return mix(hashes[at])
    return mix(hashes[at] + hashes[at - 1] * _C)


def _whole(hashes: np.ndarray, end: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m words that end at ``end``."""
    out = np.zeros(len(end), np.uint64)
    for k in range(m):
        out = out * _C + hashes[end - (m - 1) + k]
    return mix(out)


class Patterns:
    """Tables for the patterns of one length."""

    def __init__(self, m: int) -> None:
        self.m, self.size = m, min(2, m)
        self.rows: dict[bytes, tuple[np.ndarray, set[int]]] = {}

    def add(self, key: bytes, hashes: np.ndarray, item: int) -> None:
        self.rows.setdefault(key, (hashes, set()))[1].add(item)

    def compile(self) -> Patterns:
        flat = np.concatenate([h for h, _ in self.rows.values()])
        n, m = len(self.rows), self.m
        ends = np.arange(n) * m + m - 1
        bits = max(10, int(n * m).bit_length() + 3)
        self.drop = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, m - self.size + 1, np.uint8 if m < 256 else np.int64)
        for back in range(m - self.size + 1):
            slot = _block(flat, ends - back, self.size) >> self.drop
            np.minimum.at(self.shift, slot, back)
        suffix, whole = _block(flat, ends, self.size), _whole(flat, ends, m)
        order = np.argsort(whole)
        self.suffixes, self.whole = np.unique(suffix), whole[order]
        texts, items = list(self.rows), [sorted(i) for _, i in self.rows.values()]
        self.texts = [texts[k] for k in order]
        self.items = [items[k] for k in order]
        self.rows = {}
        return self

    def search(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Ends of windows, within the word ranges [first, last) of rows, whose suffix is known."""
        count = np.maximum(last - first - self.m + 1, 0)
        lanes = -(-count // LANE)
        row = np.repeat(np.arange(len(count)), lanes)
        at = (first + self.m - 1)[row] + LANE * (ragged(np.zeros(len(count), np.int64), lanes))
        stop = np.minimum(at + LANE, last[row])
        found = []
        while len(at):
            skip = self.shift[_block(hashes, at, self.size) >> self.drop].astype(np.int64)
            hit = at[skip == 0]
            if len(hit):
                found.append(hit)
            at = at + np.maximum(skip, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        ends = np.concatenate([*found, np.zeros(0, np.int64)])
        return ends[np.isin(_block(hashes, ends, self.size), self.suffixes)]


class Matcher:
    """All patterns of one block of items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int) -> None:
        self.window = window
        self.ids = sorted({i for i, _ in items if i is not None})
        index = {v: k for k, v in enumerate(self.ids)}
        by_length: dict[int, Patterns] = {}
        data, bounds = _lowered(pa.array([t for _, t in items], pa.large_string()))
        start, end, row = words(data, bounds)
        hasher = Hasher()
        hashes = hasher.ranges(hasher.running(data), start, end)
        edges = np.searchsorted(row, np.arange(len(items) + 1))
        for k, (item, _) in enumerate(items):
            lo, hi = edges[k], edges[k + 1]
            m = min(window, hi - lo)
            if not m:
                continue
            kind = by_length.setdefault(int(m), Patterns(int(m)))
            for w in range(lo, hi - m + 1):
                key = b" ".join(data[s:e].tobytes() for s, e in zip(start[w:w + m], end[w:w + m]))
                kind.add(key, hashes[w:w + m], index.get(item, -1))
        self.kinds = [by_length[m].compile() for m in sorted(by_length)]

    def scan(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray,
             edges: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Marks of hit words, and (row, item) of occurring windows."""
        step = np.zeros(len(start) + 1, np.int64)
        pairs: set[tuple[int, int]] = set()
        for kind in self.kinds:
            ends = kind.search(hashes, edges[:-1], edges[1:])
            whole = _whole(hashes, ends, kind.m)
            place = np.searchsorted(kind.whole, whole)
            place[place == len(kind.whole)] = 0
            same = kind.whole[place] == whole
            rows = np.searchsorted(edges, ends, "right") - 1
            for e, p, r in zip(ends[same].tolist(), place[same].tolist(), rows[same].tolist()):
                s = e - kind.m + 1
                text = b" ".join(data[a:b].tobytes() for a, b in zip(start[s:e + 1], end[s:e + 1]))
                while p < len(kind.whole) and kind.texts[p] != text:  # equal hashes, if ever
                    p += 1
                    if p < len(kind.whole) and kind.whole[p] != kind.whole[p - 1]:
                        p = len(kind.whole)
                if p < len(kind.whole):
                    step[s] += 1
                    step[e + 1] -= 1
                    pairs.update((r, i) for i in kind.items[p])
        return np.cumsum(step)[:-1] > 0, sorted(pairs)


SCHEMA = "n_words long, hits array<struct<start: long, stop: long>>, items array<string>"


def _scanner(matcher: Matcher):
    """Adds n_words, the hit runs of words and the ids of the items to each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for whole_batch in batches:
            _, all_bounds = utf8(whole_batch.column("text"))
            for lo, hi in slices(all_bounds):
                batch = whole_batch.slice(lo, hi - lo)
                data, bounds = _lowered(batch.column("text"))
                start, end, row = words(data, bounds)
                edges = np.searchsorted(row, np.arange(len(batch) + 1))
                hashes = hasher.ranges(hasher.running(data), start, end)
                marks, pairs = matcher.scan(data, start, end, hashes, edges)
                items = [set(i or ()) for i in batch.column("items").to_pylist()]
                for r, i in pairs:
                    if i >= 0:
                        items[r].add(str(matcher.ids[i]))
                for r, runs in enumerate(batch.column("hits").to_pylist()):
                    for run in runs or ():
                        marks[edges[r] + run["start"]:edges[r] + run["stop"]] = True
                turn = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
                opens, closes = turn == 1, turn == -1
                # a run that goes on over the edge of a row is cut there
                inner = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(marks))]
                cut = inner[marks[inner] & marks[inner - 1]]
                opens[cut] = closes[cut] = True
                first, last = np.flatnonzero(opens), np.flatnonzero(closes)
                base = edges[np.searchsorted(edges, first, "right") - 1]
                per_row = np.searchsorted(first, edges)
                runs = pa.StructArray.from_arrays(
                    [pa.array(first - base, pa.int64()), pa.array(last - base, pa.int64())],
                    ["start", "stop"])
                found = {
                    "n_words": pa.array(np.diff(edges), pa.int64()),
                    "hits": pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), runs),
                    "items": pa.array([sorted(i) for i in items], pa.list_(pa.string()))}
                yield pa.record_batch([found.get(n, batch.column(n)) for n in batch.schema.names],
                                      batch.schema.names)

    return scan


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of bounded size, each gathered by itself."""
    rows = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    total = rows.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    n = -(-int(total) // block_chars)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW,
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` (which has a column text) with n_words, hits and items.

    ``hits`` are runs of words, by number in the text, that windows cover; ``items`` are the
    ids, as sorted strings, of the items whose windows occur.
    """
    frame = docs.withColumns({
        "n_words": F.lit(0).cast("long"),
        "hits": F.lit(None).cast("array<struct<start: long, stop: long>>"),
        "items": F.lit(None).cast("array<string>")})
    schema, passes = frame.schema, 0
    for block in _blocks(items, block_chars):
        before = stored(frame, "decontaminate") if passes else frame
        frame = before.mapInArrow(_scanner(Matcher(block, window)), schema)
        passes += 1
    return frame if passes else frame.mapInArrow(_scanner(Matcher([], window)), schema)


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``."""
    found = search(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, window)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"),
                        lambda a, run: a + run["stop"] - run["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with all its columns, less the rows in which a window of an item occurs."""
    rows = plain_names(docs)
    clean = search(rows, items, window).where(F.size("hits") == 0)
    return clean.select(*rows.columns).toDF(*docs.columns)
