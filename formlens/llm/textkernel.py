"""Vectorised word and shingle hashing over Arrow text batches (numpy, one pass over the bytes).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash is
the sum of its bytes' mixed (place, byte) codes, so no Python object is made per word and, unlike in a
polynomial over 2**64, words of a regular structure don't collide.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their task, beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with freed memory given back once it has ended: inside it, its last batches and arrays are still held."""

    @wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]):
        yield from run(batches)
        release()

    return outer


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser; every salt is another hash function."""
    x = x ^ U((salt * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def run_hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each run [start, end) of codes below 2**32; runs are in order, not empty and don't overlap."""
    if not len(start):
        return np.zeros(0, U)
    size = end - start
    first = np.r_[0, np.cumsum(size)[:-1]]
    place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    code = code[place + np.repeat(start, size)].astype(U) | place.astype(U) << U(32)
    return mix(np.add.reduceat(mix(code, 41), first) + size.astype(U))


@dataclass
class Words:
    """Words of a chunk of documents: byte spans, owning document (index in the chunk) and hash."""

    raw: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first word of each document, and the end


def chunks(text: pa.Array, max_bytes: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text each (one row at least)."""
    if not len(text):
        return
    off = byte_offsets(text)
    lo = 0
    while lo < len(text):
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), len(text))
        yield lo, hi
        lo = hi


def byte_offsets(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    return np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1]


def as_text(column) -> pa.Array:
    """One array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def words(text: pa.Array, lower: bool = True) -> Words:
    off = byte_offsets(text).astype(np.int64)
    buf = text.buffers()[2]
    raw = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    n = len(raw)
    data = LOWER[raw] if lower else raw
    solid = ~SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = run_hashes(data, start, end)
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(raw, data, off, start, end, doc, h, first)


def shingle_sets(w: Words, size: int = 5) -> Iterator[np.ndarray]:
    """For each document its sorted distinct shingle hashes: ``size`` words each, a shorter text as one shingle."""
    n = len(w.hash)
    rolled = np.zeros(max(n - size + 1, 0), U)
    for j in range(size if len(rolled) else 0):
        rolled += mix(w.hash[j : j + len(rolled)], 11 + j)
    rolled = mix(rolled, 7)
    for lo, hi in zip(w.first[:-1], w.first[1:], strict=True):
        if hi - lo >= size:
            yield np.unique(rolled[lo : hi - size + 1])
        elif hi > lo:
            short = sum((mix(w.hash[lo + j : lo + j + 1], 11 + j) for j in range(hi - lo)), np.full(1, 31 * (hi - lo), U))
            yield mix(short, 8)
        else:
            yield np.zeros(0, U)


def set_key(u: np.ndarray, salt: int = 0) -> int:
    """Order-free 64-bit key of a set of hashes, as a signed integer (0 for the empty set); every salt is another function."""
    if not len(u):
        return 0
    return int(mix(np.array([mix(u, 21 + 2 * salt).sum(dtype=U)], U) + U(len(u)), 22 + 2 * salt).view(np.int64)[0])
