"""Vectorised word and n-gram hashes over whole Arrow batches (numpy, used inside tasks)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 18
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def release() -> None:
    """Gives memory that is no longer held back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over the batches of a task, with memory released at its end."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()
    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _PIECE), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * _PIECE:
            _powers[base] = have
    return have[:n]


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE,
                fold: np.ndarray = SAME, first_bytes: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words before each row (one entry more than rows).

    Words are maximal runs of bytes outside ``space``; rows end words. ``fold`` maps bytes first.
    With ``first_bytes``, the hash is that of the word's beginning of at most so many bytes.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    solid = ~space[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid
    last = last.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(data, starts, ends, fold, first_bytes), np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME,
                first_bytes: int = 0) -> np.ndarray:
    """Hash of the bytes of every span; spans ascend and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):  # pieces that fit the cache
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        part = np.zeros(hi - lo + 1, dtype=np.uint64)
        read = data[lo:hi] if fold is SAME else fold[data[lo:hi]]
        np.cumsum((read.astype(np.uint64) + U(1)) * _power(_BASE, hi - lo), out=part[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        if first_bytes:
            e = np.minimum(e, s + first_bytes)
        out[i:j] = (part[e] - part[s]) * _power(_INVERSE, hi - lo)[s]
        i = j
    return mix(out)


def grams(h: np.ndarray, n: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Unmixed polynomial hash of every run of ``n`` neighbours, by doubling."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    have, width, power, done, at = h, 1, seed | 1, None, 0
    left, mask = n, (1 << 64) - 1
    while True:
        if left & 1:
            if done is None:
                done, at = have, width
            else:
                size = len(h) - (at + width) + 1
                done = done[:size] + U(pow(seed | 1, at, 1 << 64)) * have[at:at + size]
                at += width
        left >>= 1
        if not left:
            return done[:len(h) - n + 1]
        size = len(h) - 2 * width + 1
        have = have[:size] + U(power) * have[width:width + size]
        power, width = power * power & mask, 2 * width


def inside(before: np.ndarray, n: int) -> np.ndarray:
    """Whether the run of ``n`` words at each word start lies in one row (length: words - n + 1)."""
    total = int(before[-1])
    if total < n:
        return np.zeros(0, dtype=bool)
    whole = np.ones(total - n + 1, dtype=bool)
    for k in range(1, n):  # the last starts of each row
        late = before[1:] - k
        whole[late[(late >= 0) & (late < len(whole))]] = False
    return whole
