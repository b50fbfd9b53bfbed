"""Vectorised word splitting and hashing over whole Arrow batches.

Texts are handled as one UTF-8 buffer per batch.  A word is a maximal run of
bytes outside ``[\\x20\\x09-\\x0D]``; A-Z count as a-z.  The 64-bit hash of a
word is a polynomial over a fixed table of byte values modulo 2**64, mixed at
the end, so that it needs a few passes of numpy over the bytes and no Python
object per word, and is the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over uint64, in place on a copy."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _table() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_BYTE_VALUE = _table()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = np.ones(1, dtype=U64)
_inverse_powers = np.ones(1, dtype=U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base, inverse = np.full(size, U64(_BASE)), np.full(size, U64(_BASE_INVERSE))
        base[0] = inverse[0] = 1
        _powers, _inverse_powers = np.cumprod(base, dtype=U64), np.cumprod(inverse, dtype=U64)
    return _powers, _inverse_powers


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column end to end, and n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return data[first:last], (offsets - first if len(offsets) else np.zeros(1, np.int64))


class Words:
    """Words of a batch: ``hashes``, byte ``starts`` and ``ends``, and ``offsets`` of each text's words."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray):
        self.hashes, self.starts, self.ends, self.offsets = hashes, starts, ends, offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def split_words(data: np.ndarray, offsets: np.ndarray, block: int = 250_000) -> Words:
    """Hashed words of every text.  ``block`` bounds the bytes for which temporary arrays are held."""
    hashes, starts, ends = [], [], []
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets[offsets <= n]] = True
    at = 0
    while at < n:
        stop = min(n, at + block)
        while stop < n and not (edge[stop] or _SPACE[data[stop]]):  # never inside a word
            step = data[stop : stop + 4096]
            cut = np.flatnonzero(_SPACE[step] | edge[stop : stop + len(step)])
            stop = stop + int(cut[0]) if len(cut) else min(n, stop + 4096)
        part = data[at:stop]
        inside = ~_SPACE[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[at + 1 : stop]
        finishes = inside.copy()
        finishes[:-1] &= ~inside[1:] | edge[at + 1 : stop]
        s, e = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        if len(s):
            power, inverse = _power_tables(len(part) + 1)
            total = np.zeros(len(part) + 1, dtype=U64)
            np.cumsum(_BYTE_VALUE[part] * power[: len(part)], out=total[1:], dtype=U64)
            hashes.append(mix((total[e] - total[s]) * inverse[s]))
            starts.append(s + at)
            ends.append(e + at)
        at = stop
    if not hashes:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), empty, empty, np.zeros(len(offsets), np.int64))
    s = np.concatenate(starts)
    return Words(np.concatenate(hashes), s, np.concatenate(ends), np.searchsorted(s, offsets))


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``width`` words (a shorter text is one run), and n+1 offsets."""
    counts = words.counts
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    rolled = words.hashes.copy()
    n = len(rolled)
    length = np.minimum(np.repeat(counts, counts), width)
    for k in range(1, width):
        nxt = np.zeros(n, dtype=U64)
        nxt[: n - k] = words.hashes[k:]
        nxt[length <= k] = U64(k)
        rolled = mix(rolled * U64(0xD6E8FEB86659FD93) + nxt)
    place = np.arange(n) - np.repeat(words.offsets[:-1], counts)
    rolled = rolled[place < np.repeat(sizes, counts)]
    at = np.concatenate([[0], np.cumsum(sizes)])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        rolled[a:b].sort()
    fresh = np.ones(len(rolled), dtype=bool)
    fresh[1:] = rolled[1:] != rolled[:-1]
    fresh[at[:-1][sizes > 0]] = True
    before = np.concatenate([[0], np.cumsum(fresh)])
    return rolled[fresh], before[at]
