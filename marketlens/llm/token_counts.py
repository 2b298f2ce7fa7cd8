"""Token counts by compiled finite-state transducers.

The tokenizer is compiled to two deterministic transducers in cascade. The first reads
character classes and marks on its transitions where a pre-token begins; its few states
say what kind of pre-token is open. Texts are cut into chunks of ``CHUNK`` characters that
run side by side, from every state at once, so a chunk becomes a map from states to states;
a parallel prefix scan composes the maps of a text and gives each chunk its true start.
The second reads a whole pre-token; its closing transition carries the number of tokens
that the pre-token emits. Its transitions are compiled when first needed, by the
tokenizer itself, and kept for the life of the worker. Counts per text are the sums of what
its transitions emit.

The classes of all code points are compiled on the driver by asking the tokenizer which
characters it joins to a letter, a digit or a sign, so they match its own Unicode tables.
Only the byte-level pre-tokenizer with its own pattern is compiled; any other tokenizer is
refused. Special strings inside texts count as the tokenizer's default does: one each.

Edge cases: null and empty texts have no tokens. Rows are independent, so repeated rows,
null ids and other columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.text import slices, utf8

CHUNK = 256
KNOWN = 1_000_000  # pre-tokens whose closing transition a worker remembers
SLICE = 1_000_000

# character classes, then the symbols that look ahead: an apostrophe that may open a
# contraction of two or three characters, and white space before a character that is none
LETTER, DIGIT, SIGN, TWO, THREE, BLANK_ON, SPACE_ON, BLANK, END = range(9)
SPACE = 9  # a class only: the blank itself
NONE, IN_LETTERS, IN_DIGITS, IN_SIGNS, AFTER_SPACE, IN_BLANKS, LAST, MORE, CLOSED = range(9)


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether the character begins a pre-token, by state and symbol."""
    state = np.zeros((9, 9), np.uint8)
    begins = np.ones((9, 9), bool)
    runs = {LETTER: IN_LETTERS, DIGIT: IN_DIGITS, SIGN: IN_SIGNS}
    for s in range(9):
        for symbol, run in runs.items():
            state[s, symbol] = run
            begins[s, symbol] = s not in (run, AFTER_SPACE)
        for symbol, open_ in ((TWO, LAST), (THREE, MORE)):
            joins = s in (IN_SIGNS, AFTER_SPACE)
            state[s, symbol] = IN_SIGNS if joins else open_
            begins[s, symbol] = not joins
        state[s, SPACE_ON] = AFTER_SPACE
        state[s, BLANK_ON] = state[s, BLANK] = IN_BLANKS
        begins[s, BLANK] = s != IN_BLANKS
        state[s, END], begins[s, END] = s, False
    for s, then in ((LAST, CLOSED), (MORE, LAST)):  # inside a contraction
        state[s, LETTER], begins[s, LETTER] = then, False
    return state, begins


@functools.cache
def compile_classes(path: str) -> bytes:
    """The class of every code point, compressed (a few KB).

    The tokenizer cuts the row of all code points where the class changes; the first
    character of each stretch is then tried after a letter, a digit and a sign.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    points = [p for p in range(0x110000) if not 0xD800 <= p <= 0xDFFF and p != 0x20]
    cuts = [span for _, span in split("".join(map(chr, points)))]
    heads = [chr(points[start]) for start, _ in cuts]
    joined = []
    for probe in "a1!":
        starts = {start for _, (start, _) in split("\n".join(probe + h for h in heads))}
        joined.append(np.array([3 * k + 1 not in starts for k in range(len(heads))]))
    letter, digit, sign = joined
    kinds = np.select([letter, digit, sign], [LETTER, DIGIT, SIGN], BLANK)
    out = np.full(0x110000, SIGN, np.uint8)
    out[points] = np.repeat(kinds, [end - start for start, end in cuts])
    out[0x20] = SPACE
    return zlib.compress(out.tobytes())


def symbols(codes: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of the concatenated texts; ``first`` holds the starts of the texts."""
    kind = classes[codes]
    n = len(codes)
    ahead = np.full(n + 2, BLANK, np.uint8)
    ahead[:n] = kind
    last = np.zeros(n + 2, bool)  # no look over the end of a text
    last[first[(first > 0) & (first <= n)] - 1] = True
    last[n - 1:] = True
    solid = (ahead[1:n + 1] < TWO) & ~last[:n]
    out = kind.copy()
    blank, space = kind == BLANK, kind == SPACE
    out[blank & solid], out[space & solid], out[space & ~solid] = BLANK_ON, SPACE_ON, BLANK
    mark = np.flatnonzero(codes == 0x27)
    mark = mark[~last[mark]]
    one = codes[mark + 1]
    out[mark[np.isin(one, [ord(c) for c in "stmd"])]] = TWO
    mark = mark[~last[mark + 1]]
    one, two = codes[mark + 1], codes[mark + 2]
    long = np.zeros(len(mark), bool)
    for pair in ("re", "ve", "ll"):
        long |= (one == ord(pair[0])) & (two == ord(pair[1]))
    out[mark[long]] = THREE
    return out


def chunk_maps(symbols_: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks as a padded matrix, their state maps, and which of them open a text."""
    size = np.diff(np.append(first, len(symbols_)))
    count = -(-size // CHUNK)
    opens = np.zeros(int(count.sum()), bool)
    opens[(np.cumsum(count) - count)[count > 0]] = True
    row = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = first[row] + number * CHUNK
    length = np.minimum(CHUNK, first[row] + size[row] - at)
    grid = np.full((len(row), CHUNK), END, np.uint8)
    grid[np.arange(CHUNK) < length[:, None]] = symbols_  # chunks follow the order of the texts
    state, _ = transitions()
    flat = state.ravel()
    maps = np.tile(np.arange(9, dtype=np.uint8), (len(row), 1))
    for column in np.ascontiguousarray(grid.T):
        maps = flat[maps * np.uint8(9) + column[:, None]]
    return grid, maps, opens


def scan(maps: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The state in which each chunk starts: prefix composition of the maps, text by text."""
    maps, closed, step = maps.copy(), opens.copy(), 1
    while step < len(maps) and not closed.all():
        open_ = np.flatnonzero(~closed[step:]) + step
        before = open_ - step
        composed = np.take_along_axis(maps[open_], maps[before].astype(np.int64), 1)
        closed_too = closed[before]
        maps[open_] = composed
        closed[open_] = closed_too
        step *= 2
    start = np.full(len(maps), NONE, np.uint8)
    start[1:] = np.where(opens[1:], NONE, maps[:-1, NONE])
    return start


def pre_token_starts(symbols_: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which characters begin a pre-token."""
    grid, maps, opens = chunk_maps(symbols_, first)
    state, begins = transitions()
    now, marks = scan(maps, opens), np.zeros(grid.shape, bool)
    next_, emits = state.ravel(), begins.ravel()
    for k, column in enumerate(np.ascontiguousarray(grid.T)):
        edge = now * np.uint8(9) + column
        marks[:, k] = emits[edge]
        now = next_[edge]
    return marks[grid != END]


class Counter:
    """Both transducers, as a worker holds them."""

    def __init__(self, path: str, classes: bytes) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.classes = np.frombuffer(zlib.decompress(classes), np.uint8)
        self.special = [t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]]
        self.known: dict[bytes, int] = {}

    def closing(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Tokens that each pre-token emits when it closes."""
        if len(self.known) > KNOWN:
            self.known = {}
        fresh = [p for p in pre_tokens if p not in self.known]
        got = self.tokenizer.encode_batch([p.decode() for p in fresh], add_special_tokens=False)
        self.known.update((p, len(e.ids)) for p, e in zip(fresh, got, strict=True))
        return np.array([self.known[p] for p in pre_tokens], np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each of the texts, none of which holds a special string."""
        data, bounds = utf8(texts)
        if not len(data):
            return np.zeros(len(texts), np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte offsets of the characters
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.searchsorted(lead, bounds[:-1])
        starts = lead[pre_token_starts(symbols(codes, self.classes, first), first)]
        offsets = np.append(starts, len(data)).astype(np.int64)
        tokens = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = tokens.dictionary_encode()
        emitted = self.closing(coded.dictionary.to_pylist())[
            coded.indices.to_numpy(zero_copy_only=False)]
        total = np.concatenate([[0], np.cumsum(emitted)])
        return np.diff(total[np.searchsorted(starts, bounds)])

    def batch(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = functools.reduce(pc.or_, (pc.match_substring(texts, s) for s in self.special),
                                  pa.array(np.zeros(len(texts), bool)))
        out = np.zeros(len(texts), np.int64)
        hit = marked.to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(hit):
            parts = [texts[int(k)].as_py()]
            for s in self.special:
                pieces = [p.split(s) for p in parts]
                out[k] += sum(len(p) - 1 for p in pieces)
                parts = [x for p in pieces for x in p]
            out[k] += self.count(pa.array(parts, pa.large_string())).sum()
        if not hit.all():
            out[~hit] = self.count(texts.filter(pa.array(~hit)))
        return out


def _counter(path: str, classes: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, classes)
        for batch in batches:
            _, bounds = utf8(batch.column("text"))
            for lo, hi in slices(bounds, SLICE):
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"),
                    "n_bytes": pa.array(np.diff(bounds[lo:hi + 1]), pa.int64()),
                    "n_tokens": pa.array(counter.batch(part.column("text")), pa.int64())})

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``."""
    with open(tokenizer, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"]:
        raise ValueError("only byte-level tokenizers without normaliser can be compiled")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.mapInArrow(_counter(tokenizer, compile_classes(tokenizer)),
                              "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
