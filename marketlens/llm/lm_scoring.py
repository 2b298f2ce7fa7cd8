"""Document probabilities by a lattice of subwords, words and stretches of words.

The model is a mixture over segmentations. Its units are the 256 bytes and the pieces of an
existing vocabulary, the words seen in training, and the stretches of words seen in training.
A word's probability is its own discounted share plus, with the mass that discounting frees, the
marginal of its subword lattice: the sum over all segmentations into pieces, by the forward
recursion in log space (``subword_lattice``). Stretches are cut where the hash of a word says
so (one in ``SPACING``), so a text that repeats another has the same stretches; a stretch has its
own discounted share plus the freed mass times the product of its words. A document is its
stretches, the last of which holds the end. All masses sum to at most one.

The vocabulary and its scores come with the file; the scores are refitted by ``ROUNDS`` of
expectation maximisation, forward and backward, over all distinct training words, since a word
is spelt once for all its uses. Discounts follow from the numbers of units seen once and twice.

The corpus is read once, into blocks of about ``BLOCK`` bytes of text: distinct words and
stretches with their counts, and the documents as numbers of these. Words and stretches meet
their corpus counts by one row a block, so a word in every document is a row a block, and
the figures go back to the blocks, which are bounded. Expected uses of pieces are as many
numbers as the vocabulary has pieces.

Edge cases: null and empty texts are the end alone. A row without id is learnt from. Rows are
independent, so repeated rows count as often as they occur and are scored alike. Other columns
are ignored. Without training documents all words are spelt by the first scores. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.periodic_runs import words
from marketlens.llm.shared import stored
from marketlens.llm.subword_lattice import Lattice, read_vocabulary
from marketlens.llm.text import LOWER, Hasher, mix, per_worker, powers, ragged, slices, utf8

BLOCK = 4_000_000
SPACING = 8
ROUNDS = 2
LEAST = 0.01  # expected uses that every piece has
TOGETHER = 30_000  # words whose lattices are walked side by side

BLOCKS = ("block long, ids array<long>, held array<boolean>, words array<string>, uses array<long>, "
          "hashes array<long>, times array<long>, texts binary")


def _listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of small numbers, each in the narrowest type that holds it, compressed."""
    parts = []
    for array in arrays:
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64)
                    if int(array.max(initial=0)) <= np.iinfo(t).max)
        parts += [struct.pack("<BQ", np.dtype(kind).itemsize, len(array)), array.astype(kind).tobytes()]
    return zstandard.ZstdCompressor().compress(b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        width, n = struct.unpack_from("<BQ", raw, at)
        out.append(np.frombuffer(raw, f"<u{width}", n, at + 9).astype(np.int64))
        at += 9 + width * n
    return out


def block(ids: pa.Array, held: pa.Array, texts: pa.Array, number: int) -> pa.RecordBatch:
    """One block of documents as numbers of its own distinct words and stretches."""
    data, bounds = utf8(texts)
    data = LOWER[data]
    start, end, of = words(data, bounds)
    length = end - start
    tokens = pa.Array.from_buffers(pa.large_string(), len(start), [
        None, pa.py_buffer(np.append(0, np.cumsum(length)).astype(np.int64)),
        pa.py_buffer(data[ragged(start, length)])])
    coded = tokens.dictionary_encode()
    word_of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    spelt, edge = utf8(coded.dictionary)
    hasher = Hasher()
    word_hash = hasher.ranges(hasher.running(spelt), edge[:-1], edge[1:]) if len(spelt) else (
        np.zeros(0, np.uint64))

    # stretches end after chosen words and with the document; the last one holds its end
    of_token = mix(word_hash + np.uint64(1))[word_of]
    docs = np.repeat(np.arange(len(ids)), np.diff(of))
    chosen = np.flatnonzero(of_token % np.uint64(SPACING) == 0)
    stops = np.concatenate([chosen + 1, of[1:]])
    owner = np.concatenate([docs[chosen], np.arange(len(ids))])
    last = np.repeat([0, 1], [len(chosen), len(ids)])
    order = np.lexsort((last, stops, owner))
    stops, owner, last = stops[order], owner[order], last[order]
    begins = np.where(np.append(True, owner[1:] != owner[:-1])[:len(owner)], of[owner],
                      np.append(0, stops[:-1])[:len(owner)])
    up, down = powers(Hasher.BASE, len(word_of) + 1), powers(Hasher.INVERSE, len(word_of) + 1)
    running = np.zeros(len(word_of) + 1, np.uint64)
    np.cumsum(of_token * up[:len(word_of)], out=running[1:])
    value = mix((running[stops] - running[begins]) * down[begins]
                + (2 * (stops - begins) + last).astype(np.uint64))
    hashes, stretch_of = np.unique(value.view(np.int64), return_inverse=True)

    free = held.to_numpy(zero_copy_only=False).astype(bool)
    learnt = ~free
    return pa.record_batch({
        "block": pa.array([number], pa.int64()),
        "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        "held": _listed(free, pa.bool_()),
        "words": pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()),
                                          coded.dictionary.cast(pa.string())),
        "uses": _listed(np.bincount(word_of, learnt[docs], len(coded.dictionary)).astype(np.int64),
                        pa.int64()),
        "hashes": _listed(hashes, pa.int64()),
        "times": _listed(np.bincount(stretch_of, learnt[owner], len(hashes)).astype(np.int64),
                         pa.int64()),
        "texts": pa.array([packed(
            word_of, stretch_of, np.diff(stops, prepend=0), np.diff(of),
            np.bincount(owner, minlength=len(ids)))], pa.binary())})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        _, bounds = utf8(batch.column("text"))
        for lo, hi in slices(bounds, BLOCK):
            part = batch.slice(lo, hi - lo)
            yield block(part.column("doc_id"), part.column("held"), part.column("text"), number)
            number += 1


def _discount(row) -> float:
    """Share of a count that is set free, from the units seen once and twice."""
    once, twice = row["once"] or 0, row["twice"] or 0
    return min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + len(batch), size + batch.nbytes
        if rows >= TOGETHER or size >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks().cast(pa.large_string())


def _expecting(pieces: list[str], log_p: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = per_worker(("lattice", len(pieces), hash(tuple(pieces))), lambda: Lattice(pieces))
        total = np.zeros(len(pieces))
        for part in _gathered(batches):
            total += lattice.expected(_column(part, "word"), log_p)
        used = np.flatnonzero(total)
        yield pa.record_batch({"piece": pa.array(used, pa.int64()), "expected": pa.array(total[used])})

    return run


def fit(seen: DataFrame, pieces: list[str], first: np.ndarray, rounds: int) -> np.ndarray:
    """Log-probabilities of the pieces after ``rounds`` over the distinct words ``seen``."""
    p = first
    for _ in range(rounds):
        got = seen.mapInArrow(_expecting(pieces, np.log(p)), "piece long, expected double")
        total = np.full(len(pieces), LEAST)
        for row in got.groupBy("piece").agg(F.sum("expected").alias("n")).collect():  # one a piece
            total[row["piece"]] += row["n"]
        p = total / total.sum()
    return np.log(p)


def _logs(count: np.ndarray, discount: float, total: int, freed: float, rest: np.ndarray) -> np.ndarray:
    """log of (count - discount) / total + freed * exp(rest), where a count of 0 has no share."""
    if not total:
        return rest
    with np.errstate(divide="ignore"):
        own = np.where(count > 0, np.log(np.maximum(count - discount, 0)) - math.log(total), -np.inf)
    return np.logaddexp(own, math.log(freed) + rest)


def _weighing(pieces: list[str], log_p: np.ndarray, log_word: float, words_: tuple) -> Callable:
    """For each block, its words' counts and minus their logarithms in millionths, packed.

    The rows come in the order of the words, so a word is spelt once for all its blocks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = per_worker(("lattice", len(pieces), hash(tuple(pieces))), lambda: Lattice(pieces))
        for part in _gathered(batches):
            coded = _column(part, "unit").dictionary_encode()
            number = coded.indices.to_numpy(zero_copy_only=False)
            c, at, of = (part.column(n).to_numpy() for n in ("c", "at", "block"))
            of_word = np.zeros(len(coded.dictionary), np.int64)
            of_word[number] = c
            log_w = log_word + _logs(of_word, *words_, lattice.marginals(coded.dictionary, log_p))
            less = np.rint(-1e6 * log_w).astype(np.int64)[number]
            order = np.argsort(of, kind="stable")
            blocks, cut = np.unique(of[order], return_index=True)
            rows = [packed(at[k], c[k], less[k]) for k in np.split(order, cut[1:])]
            yield pa.record_batch({"block": pa.array(blocks, pa.int64()),
                                   "weights": pa.array(rows, pa.binary())})

    return run


def _scoring(total: int, kinds: int, ends: int, log_end: float, stretches: tuple) -> Callable:
    """``stretches``: discount, total and freed mass."""
    def sums(values, size):
        return np.diff(np.append(0, np.cumsum(values))[np.cumsum(size)], prepend=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                word_of, stretch_of, in_stretch, n_words, n_stretches = unpacked(row["texts"].as_py())
                c = np.zeros(row["n_kinds"].as_py(), np.int64)
                log_w = np.zeros(len(c))
                for entry in row["weights"].as_py() or ():
                    at, c_at, less = unpacked(entry)
                    c[at], log_w[at] = c_at, less / -1e6
                again = np.array(row["times"].values, np.int64)
                if row["more"].is_valid:  # where the corpus has more than the block
                    found = row["more"].values
                    again[np.asarray(found.field("at"))] = np.asarray(found.field("c"))
                inside = sums(log_w[word_of], in_stretch)
                inside[np.cumsum(n_stretches) - 1] += log_end
                log_s = _logs(again[stretch_of], *stretches, inside)
                base = sums(np.log10(c + 1.0)[word_of], n_words) + math.log10(ends + 1)
                known = sums((c > 0).astype(np.int64)[word_of], n_words) + (ends > 0)
                yield pa.record_batch({
                    "doc_id": row["ids"].values, "held_out": row["held"].values,
                    "n_tokens": pa.array(n_words + 1, pa.int64()), "n_known": pa.array(known, pa.int64()),
                    "train_tokens": pa.array(np.full(len(n_words), total), pa.int64()),
                    "base_score": pa.array(base - (n_words + 1) * math.log10(total + kinds + 1)),
                    "score": pa.array(sums(log_s, n_stretches) / math.log(10))})

    return run


def held_out(doc_id: Column) -> Column:
    """One id in seven, by its checksum; a row without id is learnt from."""
    checksum = F.crc32(doc_id.cast("long").cast("string").cast("binary"))
    return F.coalesce(checksum % 7 == 2, F.lit(False))


def scores(docs: DataFrame, vocabulary: str, held: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row.

    ``vocabulary`` is a file of scored pieces. Rows where ``held`` holds are not learnt from.
    """
    held = held_out(F.col("doc_id")) if held is None else held
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"),
                       held.alias("held"))
    blocks = stored(rows.mapInArrow(_blocks, BLOCKS), "lm-blocks")
    pieces, start = read_vocabulary(vocabulary)

    # one row a block and unit; a unit in all blocks is ordered on disk where memory ends
    def met(unit: str, uses: str) -> DataFrame:
        rows = blocks.select("block", F.posexplode(F.arrays_zip(
            F.col(unit).alias("unit"), F.col(uses).alias("own")))).select(
            "block", F.col("pos").alias("at"), "col.unit", "col.own")
        same = Window.partitionBy("unit")
        return rows.withColumns({"c": F.sum("own").over(same), "first": F.min("block").over(same)})

    at_first = F.col("block") == F.col("first")
    once_each = [F.sum(F.when(at_first, F.col("c"))).alias("total"),
                 F.count_if(at_first & (F.col("c") > 0)).alias("kinds"),
                 F.count_if(at_first & (F.col("c") == 1)).alias("once"),
                 F.count_if(at_first & (F.col("c") == 2)).alias("twice")]
    all_words = stored(met("words", "uses").drop("own"), "lm-words")
    word = all_words.agg(*once_each).first()
    stretches = stored(met("hashes", "times").groupBy("block").agg(
        F.collect_list(F.when(F.col("c") != F.col("own"), F.struct("at", "c"))).alias("more"),
        *once_each), "lm-stretches")
    stretch = stretches.agg(*(F.sum(n).alias(n) for n in ("total", "kinds", "once", "twice"))).first()
    ends = blocks.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    log_p = fit(all_words.where(at_first & (F.col("c") > 0)).select(F.col("unit").alias("word")),
                pieces, start, ROUNDS)

    n_words, n_stretches = word["total"] or 0, stretch["total"] or 0
    d_word, d_stretch = _discount(word), _discount(stretch)
    in_words = (d_word, n_words, d_word * word["kinds"] / max(n_words, 1))
    in_stretches = (d_stretch, n_stretches,
                    d_stretch * (stretch["kinds"] or 0) / max(n_stretches, 1))
    share_of_ends = (ends + 1) / (n_words + ends + 2)
    weights = all_words.select("block", "at", "c", "unit").mapInArrow(
        _weighing(pieces, log_p, math.log1p(-share_of_ends), in_words), "block long, weights binary")
    whole = (blocks.select("block", "ids", "held", "times", "texts", F.size("words").alias("n_kinds"))
             .join(weights.groupBy("block").agg(F.collect_list("weights").alias("weights")), "block", "left")
             .join(stretches.select("block", "more"), "block", "left").drop("block"))
    return whole.mapInArrow(
        _scoring(n_words + ends, word["kinds"] + (ends > 0), ends, math.log(share_of_ends), in_stretches),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")
