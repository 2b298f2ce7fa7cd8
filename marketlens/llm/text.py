"""Vectorised text helpers for Arrow batches: byte buffers, words, hashes, ragged gathers."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def per_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """An object that the tasks of one Python worker share, made when first asked for.

    Functions are sent to workers with their code, module variables included, so what shall
    outlive a task is kept beside the loaded modules.
    """
    kept = sys.modules.setdefault("_marketlens_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the offsets between them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(bounds):
        bounds = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``limit`` bytes; a longer row is alone."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i < n."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of byte ranges out of one running polynomial sum."""

    BASE = 0xD6E8FEB86659FD93
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = powers(self.BASE, n), powers(self.INVERSE, n)

    def running(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * self.up[:len(data)], out=out[1:])
        return out

    def ranges(self, running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((running[end] - running[start]) * self.down[start]
                   + (end - start).astype(np.uint64))


WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of digits, a-z and non-ASCII in lower-cased bytes.

    Runs never cross a row. ``data`` and ``bounds`` must begin at 0.
    """
    inside = WORD_BYTE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    cut = inner[inside[inner] & inside[inner - 1]]
    first[cut] = True
    last[cut - 1] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ranges start[i] .. start[i] + length[i]."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) - np.repeat(ends - length - start, length)
