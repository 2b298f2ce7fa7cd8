"""Periodic runs of words by seed and extend along diagonals.

A run is a stretch of words with smallest period q, at least ``max(MIN, 2 q)`` words long,
that no neighbour extends. On the diagonal of lag q (words q apart) it is a stretch of equal
words, at least ``max(MIN - q, q)`` long. Lags are taken in classes [k, 2k), the first being
1 .. MIN - 1; all runs of a class share an overlap of at least k words, so the k-grams of each
text are indexed (named exactly, by doubling) and pairs of occurrences whose distance lies
in the class are seeds. Neighbouring seeds of a lag are one; what is left is extended word by
word in both directions, unless the lag's furthest covered word lies beyond the seed.

Pairs are never enumerated without bound. Occurrences of a gram whose own period p is at most
k / 2 may lie close together, but such a gram lies inside a run of period p of an earlier
class. Two occurrences in one such run give nothing but that run, and runs whose overlap holds
only such grams lie across two runs of period p that touch: these pairs of runs give their
lags directly, as an arithmetic progression. All other grams have at most a few occurrences
in reach, so a text of n words costs O(n log n), one word repeated n times included.

Each text is searched where it is read; nothing is shuffled. Edge cases: null and empty texts
have no words and no runs. Rows are independent, so repeated rows, null ids and
other columns change nothing. Words are compared as bytes. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import plain_names
from marketlens.llm.text import ragged, slices, utf8

MIN = 12
WORD = r"[^\x20\x09-\x0D]+"
SLICE = 1_000_000
STEPS = 4  # words by which all seeds are extended together, before each goes on alone

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each row."""
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, bounds)


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for equal keys, and which of them occur again."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    return name, count[name] > 1


class Diagonals:
    """Runs of one array of symbols; equal symbols lie in the same text."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.s, self.n = symbols, len(symbols)
        self.start = self.end = self.period = np.zeros(0, np.int64)

    def _join(self, at: np.ndarray, name: np.ndarray, ahead: int, width: int,
              other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and names of the grams put together from those at a position and ``ahead``
        of it, where both occur again. ``name`` is -1 for grams that occur once."""
        other = name if other is None else other
        at = at[at + width <= self.n]
        at = at[(name[at] >= 0) & (other[at + ahead] >= 0)]
        got, again = _named(name[at] * np.int64(self.n + 1) + other[at + ahead])
        out = np.full(self.n, -1, np.int64)
        out[at[again]] = got[again]
        return at[again], out

    def extend(self, lag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """Whole stretches of equal words on the diagonals, from parts lo .. hi of them."""
        order = np.lexsort((lo, lag))
        lag, lo, hi = lag[order], lo[order].copy(), hi[order].copy()
        going_up = going_down = np.arange(len(lag))
        for _ in range(STEPS):
            up = going_up[hi[going_up] + lag[going_up] < self.n]
            going_up = up[self.s[hi[up]] == self.s[hi[up] + lag[up]]]
            hi[going_up] += 1
            down = going_down[lo[going_down] > 0]
            going_down = down[self.s[lo[down] - 1] == self.s[lo[down] - 1 + lag[down]]]
            lo[going_down] -= 1
        kept = np.ones(len(lag), bool)
        furthest: dict[int, int] = {}
        for k in np.union1d(going_up, going_down):
            q = int(lag[k])
            if furthest.get(q, -1) > lo[k]:
                kept[k] = False
                continue
            lo[k], hi[k] = self._back(q, int(lo[k])), self._on(q, int(hi[k]))
            furthest[q] = int(hi[k])
        found = np.unique(np.stack([lag[kept], lo[kept], hi[kept]]), axis=1)
        return found[0], found[1], found[2]

    def _on(self, q: int, hi: int) -> int:
        step = 64
        while hi + q < self.n:
            size = min(step, self.n - q - hi)
            differ = self.s[hi:hi + size] != self.s[hi + q:hi + q + size]
            if differ.any():
                return hi + int(differ.argmax())
            hi, step = hi + size, 2 * step
        return hi

    def _back(self, q: int, lo: int) -> int:
        step = 64
        while lo > 0:
            size = min(step, lo)
            differ = (self.s[lo - size:lo] != self.s[lo - size + q:lo + q])[::-1]
            if differ.any():
                return lo - int(differ.argmax())
            lo, step = lo - size, 2 * step
        return lo

    def _inside(self, width: int) -> np.ndarray:
        """Which grams of ``width`` words lie in a known run of at most half that period."""
        which = (2 * self.period <= width) & (self.end - self.start >= width)
        steps = np.zeros(self.n + 1, np.int64)
        np.add.at(steps, self.start[which], 1)
        np.add.at(steps, self.end[which] - width + 1, -1)
        return np.cumsum(steps[:-1]) > 0

    def _accept(self, lag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Keep the stretches that are long enough and have no smaller period."""
        end = hi + lag
        long = hi - lo >= np.maximum(MIN - lag, lag)
        lag, lo, end = lag[long], lo[long], end[long]
        if len(self.start):
            order = np.argsort(self.start, kind="stable")
            reach = np.maximum.accumulate(self.end[order])
            before = np.searchsorted(self.start[order], lo, "right") - 1
            free = (before < 0) | (reach[np.maximum(before, 0)] < end)
            lag, lo, end = lag[free], lo[free], end[free]
        self.start = np.concatenate([self.start, lo])
        self.end = np.concatenate([self.end, end])
        self.period = np.concatenate([self.period, lag])

    def _across(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of lags low .. high - 1 across two touching runs of one small period."""
        out: list[tuple[int, int, int]] = []
        which = np.flatnonzero(2 * self.period <= low)
        which = which[np.lexsort((self.start[which], self.period[which]))]
        a, b, p = self.start[which], self.end[which], self.period[which]
        touch = (p[1:] == p[:-1]) & (a[1:] <= b[:-1]) if len(which) else np.zeros(0, bool)
        for k in np.flatnonzero(touch):
            q, a1, b1, a2, b2 = int(p[k]), int(a[k]), int(b[k]), int(a[k + 1]), int(b[k + 1])
            last = min(b1 - a1, b2 - a2, (b2 - a1) // 2, high - 1)
            if last < low:
                continue
            # where the second run's first words stand in the first
            text, want = self.s[a1:a1 + 2 * q].tobytes(), self.s[a2:a2 + q].tobytes()
            at = text.find(want)
            while at % 8 and at >= 0:
                at = text.find(want, at + 1)
            if at < 0:
                continue
            phase = (a2 - a1 - at // 8) % q
            lags = range(low + (phase - low) % q, last + 1, q) if phase else ()
            out += [(x, max(a1, a2 - x), min(b1, b2 - x)) for x in lags]
        return tuple(np.array(out, np.int64).reshape(-1, 3).T)

    def find(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and periods of all runs, by start, then period."""
        name, again = _named(self.s)
        one = np.where(again, name, -1)
        every = np.arange(self.n)
        at, two = self._join(every, one, 1, 2)
        at, three = self._join(at, two, 2, 3, one)
        width = MIN // 2
        at, name = self._join(at, three, 3, width)
        low = 1
        while len(at):
            high = 2 * width
            apart = at[~self._inside(width)[at]] if low > 1 else at
            apart = apart[np.argsort(name[apart], kind="stable")]
            lags, seeds = [], []
            for r in range(1, len(apart)):
                gap = apart[r:] - apart[:-r]
                near = (name[apart[r:]] == name[apart[:-r]]) & (gap < high)
                if not near.any():
                    break
                near &= gap >= low
                lags.append(gap[near])
                seeds.append(apart[:-r][near])
            if lags:
                lag, seed = np.concatenate(lags), np.concatenate(seeds)
                order = np.lexsort((seed, lag))
                lag, seed = lag[order], seed[order]
                new = np.ones(len(lag) + 1, bool)
                new[1:-1] = (lag[1:] != lag[:-1]) | (seed[1:] != seed[:-1] + 1)
                cut = np.flatnonzero(new)
                parts = lag[cut[:-1]], seed[cut[:-1]], seed[cut[1:] - 1] + width
            else:
                parts = (np.zeros(0, np.int64),) * 3
            if low > 1:
                parts = tuple(map(np.concatenate, zip(parts, self._across(low, high), strict=True)))
            lag, lo, hi = self.extend(*parts)
            # below the first width a lag may be a multiple of another of the class
            for these in [lag == q for q in range(low, high)] if low == 1 else [lag > 0]:
                self._accept(lag[these], lo[these], hi[these])
            low = high
            at, name = self._join(at, name, width, high)
            width = high
        order = np.lexsort((self.period, self.start))
        return self.start[order], (self.end - self.start)[order], self.period[order]


def search(texts: pa.Array) -> Iterator[tuple[int, int, list, list, pa.Array]]:
    """Slices of the rows: first, last, number of words, runs, and the texts without repeats."""
    whole, edges = utf8(texts)
    for first, last in slices(edges, SLICE):
        data, bounds = whole[edges[first]:edges[last]], edges[first:last + 1] - edges[first]
        start, end, of = words(data, bounds)
        size = np.diff(of)
        row = np.repeat(np.arange(len(size)), size)
        length = end - start
        solid = data[ragged(start, length)]
        tokens = pa.Array.from_buffers(pa.large_binary(), len(start), [
            None, pa.py_buffer(np.append(0, np.cumsum(length)).astype(np.int64)),
            pa.py_buffer(solid)])
        coded = tokens.dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at, n, period = Diagonals(row * np.int64(len(coded.dictionary) + 1) + ids).find()

        gone = np.zeros(len(start) + 1, np.int64)
        np.add.at(gone, at + period, 1)
        np.add.at(gone, at + n, -1)
        kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
        # the kept words, each with a blank behind it; the last blank of a row is cut off
        out_length = length[kept] + 1
        ends = np.cumsum(out_length)
        out = np.full(int(ends[-1]) if len(kept) else 0, 0x20, np.uint8)
        out[ragged(ends - out_length, length[kept])] = data[ragged(start[kept], length[kept])]
        count = np.bincount(row[kept], minlength=len(size))
        bytes_ = np.bincount(row[kept], out_length, len(size)).astype(np.int64) - (count > 0)
        inner = np.ones(len(out), bool)
        inner[(ends - 1)[np.cumsum(count)[count > 0] - 1]] = False
        collapsed = pa.Array.from_buffers(pa.large_string(), len(size), [
            None, pa.py_buffer(np.append(0, np.cumsum(bytes_)).astype(np.int64)),
            pa.py_buffer(out[inner])])
        at_row = row[at]
        edge = np.searchsorted(at_row, np.arange(len(size) + 1))
        entry = pa.StructArray.from_arrays(
            [pa.array(at - of[at_row]), pa.array(n), pa.array(period)], ["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), entry)
        yield first, last, pa.array(size, pa.int64()), runs, collapsed


def _searcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index("text")
        for first, last, n, runs, collapsed in search(batch.column(at)):
            own = batch.slice(first, last - first)
            columns = [c for k, c in enumerate(own.columns) if k != at]
            names = [c for k, c in enumerate(batch.schema.names) if k != at]
            yield pa.record_batch([*columns, n, runs, collapsed],
                                  [*names, "words_", "runs_", "collapsed_"])


RUNS = "array<struct<start:long,length:long,period:long>>"


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start, then period) and ``collapsed``, the
    words that no run repeats, for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(_searcher, f"doc_id long, words_ long, runs_ {RUNS}, collapsed_ string"
                           ).toDF("doc_id", "n_words", "runs", "collapsed")


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns; of each run in a text only the first period is left.

    Texts without runs stay as they are; in others words are parted by single blanks.
    """
    plain = plain_names(docs)
    kinds = [f"{c} {t}" for c, t in plain.dtypes if c != "text"]
    found = plain.withColumn("kept_", F.col("text")).mapInArrow(
        _searcher, ", ".join([*kinds, "kept_ string", f"words_ long, runs_ {RUNS}, collapsed_ string"]))
    text = F.when(F.size("runs_") > 0, F.col("collapsed_")).otherwise(F.col("kept_"))
    return found.select(*[text.alias("text") if c == "text" else c for c in plain.columns]
                        ).toDF(*docs.columns)


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the text of one id in ten runs in a loop from some word on.

    The checksum h of the id chooses (h % 10 = 0), and with it the first word of the loop and
    its length. A row without id is left as it is.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)
    listed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"), g.alias("g"))
    n = F.size("w").cast("long")
    looping = listed.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn(
        "p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))

    def word(w: Column, i: Column) -> Column:
        return F.when(i < F.col("a"), w).otherwise(
            F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))

    return looping.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(
        F.transform("w", word), " ")).otherwise(F.col("text")).alias("text"))


def summary(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of what ``runs`` has found."""
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"], r["length"], r["period"])), "\n")
    many = F.size("runs") > 0
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-F.col("best.less") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(many, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
