"""A tokenizer of the tokenizers library that drops white space and case, for whole texts."""
from __future__ import annotations

import os

import numpy as np

from .byte_bpe import byte_characters
from .unit_memory import UnitMemory, in_a_row, words

#: Bytes that simple units hold: 1 small letter of ASCII, 2 lead byte and 3 second byte of the letters from U+00C0 to U+00FF, 4 mark of ASCII other than the
#: apostrophe, 5 the line feed after each unit.  No normal form changes these; their small letters are theirs in Latin-1 too.
_KIND = np.zeros(256, np.uint8)
_KIND[97:123] = 1
_KIND[0xC3] = 2
_KIND[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = 3
_KIND[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_KIND[10] = 5
#: The character by which byte-level models write each byte; white space stays.
_CHARACTERS = np.array([ord(c) for c in byte_characters()], "<u4")
_CHARACTERS[[10, 32]] = 10, 32
#: Bytes of text that are worked on at once.
PIECE = 1 << 21
#: Simple units that one call of the library gets.
_TOGETHER = 2000


def _simple(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The units, a line each, as bytes, and for each byte whether it shows that its unit isn't letters with ASCII marks after them."""
    data = np.frombuffer(b"\n".join([*units, b""]), np.uint8)
    kind = _KIND[data]
    odd = kind == 0
    second = kind == 3
    lead = kind == 2
    odd[1:] |= (second[1:] ^ lead[:-1]) | ((kind[:-1] == 4) & ((kind[1:] == 1) | lead[1:]))
    odd[:1] |= second[:1]
    return data, odd


class WordEncoder:
    """Ids of whole texts for a tokenizer that never looks across ASCII white space.

    For such a tokenizer (white space dropped, every piece encoded alone, lower case) the ids of a text are the ids of its
    words in a row, so each distinct word goes through the library once per worker.  ASCII case is dropped first.  A text in which
    a special token may occur is given to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core already
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for simple units, without what only other units need
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        suffix = self.tokenizer.model.end_of_word_suffix
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.last = np.array([bool(suffix) and t.endswith(suffix) for t in names])  # tokens that end a piece
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = UnitMemory(words, self._words, self.dtype, PIECE)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A run of letters of ASCII or Latin-1 is one piece, as is a run of ASCII marks after it; both go to the library's BPE model without its normaliser."""
        data, odd = _simple(units)
        line = np.flatnonzero(data == 10)
        rest = np.unique(np.searchsorted(line, np.flatnonzero(odd)))
        if len(rest):
            skip, rest = set(rest.tolist()), rest.tolist()
            simple = [i for i in range(len(units)) if i not in skip]
            others, more = in_a_row(self._library([units[i].decode() for i in rest]), self.dtype)
            ids, sizes = self._simple_words([units[i] for i in simple])
            where = np.concatenate([np.asarray(simple, np.int64), np.asarray(rest, np.int64)])
            ids, sizes = np.concatenate([ids, others]), np.concatenate([sizes, more])
            starts, back = np.cumsum(sizes) - sizes, np.argsort(where)
            starts, sizes = starts[back], sizes[back]
            total = np.cumsum(sizes)
            return ids[np.repeat(starts - total + sizes, sizes) + np.arange(len(ids))], sizes
        return self._simple_words(units)

    def _simple_words(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not units:
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        data, _ = _simple(units)
        kind = _KIND[data]
        upper = np.flatnonzero((kind[1:] == 3) & (data[1:] <= 0x9E)) + 1
        data = data.copy()
        data[upper] += 0x20
        marks = np.flatnonzero((kind[1:] == 4) & ((kind[:-1] == 1) | (kind[:-1] == 3))) + 1
        lines = np.flatnonzero(data == 10)
        pieces = 1 + np.bincount(np.searchsorted(lines, marks), minlength=len(units))
        cuts = lines[_TOGETHER - 1 :: _TOGETHER] + 1
        cuts = cuts + np.searchsorted(marks, cuts)
        text = _CHARACTERS[np.insert(data, marks, 32)]
        texts = [some.tobytes().decode("utf-32-le") for some in np.split(text, cuts)]
        ids, _ = in_a_row([e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)], self.dtype)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != pieces.sum():  # a model without marked ends, or one that doesn't know all characters
            return in_a_row(self._library([u.decode() for u in units]), self.dtype)
        return ids, np.diff(ends[np.cumsum(pieces) - 1], prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        whole = [any(s in r for s in self.special) for r in raw]
        out = self.memory.encode([b"" if direct else r.lower() for r, direct in zip(raw, whole, strict=True)])
        for i, direct in enumerate(whole):
            if direct:
                out[i] = np.asarray(self._library([texts[i]])[0], self.dtype)
        return out
