"""SetSketch registers in numpy: exponentially spaced, truncated minima.

Register ``i`` of a set holds ``K_i = 1 - floor(log_b(min h_i(d)))`` over the
set's elements, ``h_i(d)`` being exponentially distributed, truncated to
``0..255``.  Registers merge by maximum, their values agree with a probability
that grows with the Jaccard similarity, and the counts of registers that are
larger, smaller or equal estimate it jointly by likelihood.
"""

from __future__ import annotations

import numpy as np

BASE = 1.1  # b: one byte holds sets of up to about 10**9 elements
_OFFSET = 40  # levels kept for minima above 1, which sets of a few elements have


def constants(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of the registers' hash functions; fixed for all time."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(0, 1 << 31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, m, dtype=np.uint32)


def _levels(minima: np.ndarray) -> np.ndarray:
    exponential = -np.log1p(-(minima.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(1 - np.floor(np.log(exponential) / np.log(BASE)) + _OFFSET, 0, 255).astype(np.uint8)


def sketch(elements: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """Registers (texts x m, uint8) of sets of 64-bit hashes that lie end to end.  An empty set has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, m), dtype=np.uint8)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    a, b = constants(m)
    # Two independent halves of each hash: one is multiplied, the other keeps registers from being linked.
    low, high = (elements & np.uint64(0xFFFFFFFF)).astype(np.uint32), (elements >> np.uint64(32)).astype(np.uint32)
    starts = offsets[:-1][full]
    # in blocks of sets whose elements fit into the processor's cache
    bounds = [0]
    while bounds[-1] < len(full):
        first = int(starts[bounds[-1]])
        bounds.append(max(bounds[-1] + 1, int(np.searchsorted(starts, first + 32768))))
    minima = np.empty((len(full), m), dtype=np.uint32)
    for x, y in zip(bounds[:-1], bounds[1:]):
        y = min(y, len(full))
        p, q = int(starts[x]), int(starts[y]) if y < len(full) else int(offsets[-1])
        l, h, s = low[p:q], high[p:q], starts[x:y] - p
        work = np.empty(q - p, dtype=np.uint32)
        for i in range(m):
            np.multiply(l, a[i], out=work)
            np.add(work, h, out=work)
            np.multiply(work, a[m - 1 - i], out=work)
            np.add(work, b[i], out=work)
            minima[x:y, i] = np.minimum.reduceat(work, s)
    out[full] = _levels(minima)
    return out


def jaccard(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray, steps: int = 40) -> np.ndarray:
    """Likeliest Jaccard similarity of pairs of sketches, given the sets' sizes.

    With shares ``u`` and ``v`` of the sizes and ``p(x) = -log_b(1 - x (b-1)/b)``,
    a register of the first set is larger with ``p(u - vJ)``, of the second with
    ``p(v - uJ)``.  The log-likelihood is concave; ternary search finds its peak.
    """
    m = first.shape[1]
    more, less = (first > second).sum(1), (first < second).sum(1)
    same = m - more - less
    u = n_first / np.maximum(n_first + n_second, 1)
    v = 1 - u
    top = np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(len(u)), np.minimum(top, 1.0)
    for _ in range(steps):
        one, two = low + (high - low) / 3, high - (high - low) / 3
        rising = likelihood(one) < likelihood(two)
        low, high = np.where(rising, one, low), np.where(rising, high, two)
    return (low + high) / 2
