"""Encoded units (words with what belongs to them) that a Python worker remembers, looked up a batch at a time.

A unit is a stretch of a text that a tokenizer never merges with its neighbours.  Each distinct unit goes to the tokenizers library once per
worker.  Units are found, told apart and put together by array operations; Python steps run for the distinct units of a batch only.
"""
from __future__ import annotations

from collections.abc import Callable
from itertools import chain, islice, repeat

import numpy as np
import pandas as pd

#: Units that a worker remembers before it forgets the later half; units met early are the frequent ones.
REMEMBERED = 250_000
#: Bytes of text that are worked on at once.
PIECE = 1 << 19
#: Longer units (bytes) are encoded wherever they occur and not remembered, so memory has a bound.
LONGEST = 64
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)

_CLASS = np.full(256, 4, np.uint8)  # 0 white space, 1 ASCII letter or digit, 2 byte of a wider character, 3 full stop or comma, 4 other
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_CLASS[128:255] = 2
_CLASS[255] = 0  # occurs in no UTF-8 text; parts the texts of a batch
_CLASS[[44, 46]] = 3
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def lone_marks(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Full stops and commas after a letter or digit and before white space, letter, digit or the end: pieces of their own."""
    own = kind == 3
    letter = (kind == 2) & (data != 0x97) & (data != 0xB7)
    letter[1:] &= data[:-1] == 0xC3  # two-byte letters from U+00C0
    letter[:1] = False
    own[:1] = False
    own[1:] &= (kind[:-1] == 1) | letter[:-1]
    own[:-1] &= kind[1:] <= 1
    return own


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words, of what follows a letter or digit from an ASCII mark other than the apostrophe on, and of lone marks; white space is dropped."""
    kind = _CLASS[data]
    own = lone_marks(data, kind)
    body = (kind != 0) & ~own
    first, last = body.copy(), body.copy()
    first[1:] &= ~body[:-1]
    last[:-1] &= ~body[1:]
    mark = np.flatnonzero(_MARK[data[1:]] & body[1:] & body[:-1]) + 1
    before = kind[mark - 1]
    wide = (before == 2) & (mark > 1)
    wide &= (data[mark - 2] == 0xC3) & (data[mark - 1] != 0x97) & (data[mark - 1] != 0xB7)  # two-byte letters from U+00C0
    mark = mark[(before == 1) | wide]
    first[mark] = last[mark - 1] = True
    return np.flatnonzero(first | own), np.flatnonzero(last | own) + 1


def spaced_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words with the white space before them, and of lone marks; nothing of a text is dropped."""
    kind, parted = _CLASS[data], data == 255
    own, space = lone_marks(data, kind), (kind == 0) & ~parted
    first = own.copy()
    first[1:] |= (space[1:] & ~space[:-1]) | own[:-1] | parted[:-1]
    first[0] = True
    first &= ~parted
    last = np.ones(len(data), bool)
    last[:-1] = first[1:] | parted[1:]
    return np.flatnonzero(first), np.flatnonzero(last & ~parted) + 1


def mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def distinct_units(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each unit and the first unit of each code; units have one code only if their bytes are equal.

    Up to seven bytes and their number fill a key of 64 bits.  For up to ``LONGEST`` bytes a hash proposes and the bytes decide.
    Longer units have codes of their own.
    """
    padded = raw + bytes(8)
    at = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    key = (at[starts] & _FIRST[np.minimum(size, 7)]) | (size.astype(np.uint64) << np.uint64(56))
    middle, long = np.flatnonzero((size > 7) & (size <= LONGEST)), np.flatnonzero(size > LONGEST)
    from_, to, reach = starts[middle], ends[middle], size[middle]
    h = reach.astype(np.uint64)
    steps = [np.flatnonzero(reach > 8 * k) for k in range(LONGEST // 8)]
    for k, some in enumerate(steps):
        h[some] = mixed(h[some], at[np.minimum(from_[some] + 8 * k, to[some] - 8)])
    key[middle] = h | np.uint64(1 << 63)
    key[long] = np.arange(len(long), dtype=np.uint64) | np.uint64(1 << 62)
    codes, distinct = pd.factorize(key.view(np.int64))
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    model = first[codes[middle]]
    differs = size[model] != reach
    for k, some in enumerate(steps):
        some = some[~differs[some]]
        differs[some] = at[np.minimum(from_[some] + 8 * k, to[some] - 8)] != at[np.minimum(starts[model[some]] + 8 * k, ends[model[some]] - 8)]
    own = middle[differs]
    codes[own] = len(first) + np.arange(len(own))
    return codes, np.concatenate([first, own])


def in_a_row(lists: list[list[int]], dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists, and how many each has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype, int(sizes.sum())), sizes


class UnitMemory:
    def __init__(self, split: Callable, library: Callable[[list[bytes]], list | tuple], dtype, piece: int = PIECE) -> None:
        """``split``: starts and ends of the units in an array of bytes; ``library``: ids of each of a list of units, or all of them in a row and how many each has."""
        self.split, self.library, self.dtype, self.piece = split, library, np.dtype(dtype), piece
        self.at: dict[bytes, int] = {}
        self.ends, self.store = np.zeros(1, np.int64), np.empty(0, self.dtype)

    def _keep(self, n: int) -> None:
        self.ends = self.ends[: n + 1].copy()
        self.store = self.store[: self.ends[-1]].copy()

    def _batch(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and start and number of ids of each unit."""
        starts, ends = self.split(np.frombuffer(raw, np.uint8))
        codes, first = distinct_units(raw, starts, ends)
        if len(self.at) > REMEMBERED:
            self.at = dict(islice(self.at.items(), len(self.at) // 2))
            self._keep(len(self.at))
        units = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        where = np.fromiter(map(self.at.get, units, repeat(-1)), np.int64, len(units))
        # units too long to be remembered come last and are forgotten after the batch
        new = sorted(np.flatnonzero(where < 0).tolist(), key=lambda i: len(units[i]) > LONGEST)
        known = len(self.at)
        if new:
            fresh: dict[bytes, int] = {}
            where[new] = [fresh.setdefault(units[i], known + len(fresh)) for i in new]
            ids = self.library(list(fresh))
            ids, sizes = ids if isinstance(ids, tuple) else in_a_row(ids, self.dtype)
            self.at.update((u, place) for u, place in fresh.items() if len(u) <= LONGEST)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.store = np.concatenate([self.store, ids.astype(self.dtype)])
        begin = self.ends[where][codes]
        count = self.ends[where + 1][codes] - begin
        total = np.cumsum(count)
        out = self.store[np.repeat(begin - total + count, count) + np.arange(total[-1] if len(total) else 0)]
        if len(self.ends) - 1 > len(self.at):
            self._keep(len(self.at))
        return out, starts, count

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, given as UTF-8."""
        parts = [(i, part) for i, raw in enumerate(raws) for part in _parts(raw, self.piece)]
        out: list[list[np.ndarray]] = [[] for _ in raws]
        while parts:
            taken, size = 0, 0
            while taken < len(parts) and (not taken or size + len(parts[taken][1]) <= self.piece):
                size += len(parts[taken][1]) + 1
                taken += 1
            group, parts = parts[:taken], parts[taken:]
            ids, starts, count = self._batch(b"\xff".join(part for _, part in group))
            before = np.cumsum([len(part) + 1 for _, part in group])[:-1]
            cuts = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, before)]
            for (i, _), some in zip(group, np.split(ids, cuts), strict=True):
                out[i].append(some)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def _parts(raw: bytes, piece: int) -> list[bytes]:
    """Pieces of a long text, each from a space that follows something else.  A stretch without such a place stays whole."""
    out, start = [], 0
    while len(raw) - start > piece:
        cut = raw.find(b" ", start + piece)
        while cut > 0 and raw[cut - 1] in b" \n\t\r\x0b\x0c":
            cut = raw.find(b" ", cut + 1)
        if cut < 0:
            break
        out.append(raw[start:cut])
        start = cut
    return [*out, raw[start:]]
