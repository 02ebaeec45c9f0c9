"""Draws by SHA-256 of a 32-byte seed and a 64-bit counter, for many seeds and counters at a time.

The digest of such a message is one block.  numpy runs its rounds over whole arrays, in place, without an object per draw.
"""
from __future__ import annotations

import numpy as np

_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]


def _root_bits(p: int, n: int) -> int:
    """First 32 bits of the fraction of the n-th root of p, in whole numbers."""
    low, high = 0, p << 32
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid ** n <= p << (32 * n) else (low, mid)
    return low & 0xFFFFFFFF


_START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], np.uint32)
_ROUND = [np.array(_root_bits(p, 3), np.uint32) for p in _PRIMES]
_BY = [np.array(i, np.uint32) for i in range(33)]
_HALF = np.uint64(32)
#: Draws worked on at a time: few enough to stay near the processor, enough to hide the cost of a call.
BLOCK = 32768


def _mixed(x, p: int, q: int, r: int, turn: bool, out, rest):
    """x turned right by p, by q, and turned or moved right by r; all three xored."""
    np.right_shift(x, _BY[p], out=out)
    for shift, by in ((np.left_shift, 32 - p), (np.right_shift, q), (np.left_shift, 32 - q), (np.right_shift, r), *(((np.left_shift, 32 - r),) if turn else ())):
        shift(x, _BY[by], out=rest)
        np.bitwise_xor(out, rest, out=out)
    return out


def _round(state, w, k, same, buffers):
    """One round in place; ``same`` is b xor c, and gives way to that of the next round."""
    a, b, c, d, e, f, g, h = state
    out, rest, both = buffers
    h += w
    h += k
    h += _mixed(e, 6, 11, 25, True, out, rest)
    np.bitwise_xor(f, g, out=out)
    out &= e
    out ^= g
    h += out
    d += h
    h += _mixed(a, 2, 13, 22, True, out, rest)
    np.bitwise_xor(a, b, out=both)  # majority: b, but where it differs from both others
    same &= both
    same ^= b
    h += same
    return [h, a, b, c, d, e, f, g], both, (out, rest, same)


def digests(seeds: np.ndarray, first: int, count: int) -> np.ndarray:
    """The first 64 bits of the digests of seeds (8 big-endian words a row) with the counters from ``first`` on, one row a seed."""

    def full(x, shape=(len(seeds), count)):
        return np.array(np.broadcast_to(x, shape), np.uint32, order="C")

    # the rounds of the seed's own words are the same for all its counters
    narrow = (len(seeds), 1)
    state, buffers = [full(x, narrow) for x in _START], tuple(np.empty(narrow, np.uint32) for _ in range(3))
    same = np.bitwise_xor(state[1], state[2])
    for i in range(8):
        state, same, buffers = _round(state, seeds[:, i:i + 1], _ROUND[i], same, buffers)
    state, same, buffers = [full(x) for x in state], full(same), tuple(np.empty((len(seeds), count), np.uint32) for _ in range(3))
    at = np.arange(first, first + count, dtype=np.uint64)
    words = [full(seeds[:, i:i + 1]) for i in range(8)] + [full((at >> _HALF).astype(np.uint32)), full(at.astype(np.uint32))] + [full(x) for x in (0x80000000, 0, 0, 0, 0, 320)]
    for i in range(8, 64):
        w = words[i % 16]
        if i >= 16:
            out, rest, _ = buffers
            w += _mixed(words[(i - 15) % 16], 7, 18, 3, False, out, rest)
            w += words[(i - 7) % 16]
            w += _mixed(words[(i - 2) % 16], 17, 19, 10, False, out, rest)
        state, same, buffers = _round(state, w, _ROUND[i], same, buffers)
    a, b = state[0] + _START[0], state[1] + _START[1]
    return (a.astype(np.uint64) << _HALF) | b


def picks(seeds: np.ndarray, first: int, count: int, n: int) -> np.ndarray:
    """Numbers below n: the digests modulo n."""
    return (digests(seeds, first, count) % np.uint64(n)).astype(np.int64)


def resampled(seeds: np.ndarray, above: np.ndarray, below: np.ndarray, first: int, last: int) -> np.ndarray:
    """Share sum(above) / sum(below) of every resample from ``first`` to ``last`` (left out), for seeds with equally many clusters.

    Resample k of n clusters takes those that counters k * n to k * n + n - 1 draw.  Work is done in blocks, so memory doesn't grow with resamples or clusters.
    """
    seeds_n, n = above.shape
    sums = np.zeros((2, seeds_n, last - first), np.int64)
    step = max(1, BLOCK // n)  # resamples, or parts of one, at a time
    rows = max(1, BLOCK // (min(step, last - first) * n))
    for r in range(0, seeds_n, rows):
        some = slice(r, r + rows)
        for k in range(first, last, step):
            ks = min(step, last - k)
            for j in range(0, n, BLOCK):
                size = min(n, BLOCK, n - j)
                p = picks(seeds[some], k * n + j, ks * size, n)
                for total, of in zip(sums, (above, below)):
                    total[some, k - first:k - first + ks] += np.take_along_axis(of[some], p, 1).reshape(len(p), ks, size).sum(2)
    return sums[0] / sums[1]
