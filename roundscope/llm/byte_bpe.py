"""Byte-level BPE over Arrow batches, by the tokenizers library.

A rank file lists byte strings.  Bytes are mapped to printable characters, one for one, and the ranks become a BPE model: every way to
split a token into two tokens is a merge, in the order of the ranks.  A piece that is a token itself is taken whole.
Offsets count the code points of the text; a token that holds only part of a character spans that character.
Decoding reverses the byte table; characters split over tokens come together again in the joined bytes.

Pieces never reach over a place where white space follows something else, so the words of a text, each with the white space before it, are
encoded once per worker and remembered (boundedly).  This needs white space to be spaces and line feeds; other texts go through whole.

Null text counts as empty and has no ids.  Rows that repeat a doc_id are each encoded; a null doc_id is kept.  Other columns are ignored;
an empty table gives no rows.
"""
from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import importable
from .unit_memory import UnitMemory, spaced_words

_OTHER_SPACE = re.compile("[^\\S \n]|[\x1c-\x1f\u180e\u200b\ufeff]")
_CODECS: dict[tuple[str, str], ByteCodec] = {}


def byte_characters() -> list[str]:
    """A printable character for each byte: Latin-1 where that prints, else the next from U+0100."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class ByteCodec:
    def __init__(self, path: str, pattern: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core already
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, table = read_ranks(path), byte_characters()
        name = {token: "".join(table[b] for b in token) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            pairs = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(name[a], name[b]) for a, b in sorted(pairs, key=lambda p: (ranks[p[0]], ranks[p[1]]))]
        self.tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.names = [str(i) for i in range(len(self.bytes))]
        self.memory = UnitMemory(spaced_words, self._units, "<u4")

    def _units(self, units: list[bytes]) -> list[list[int]]:
        """A space and a run of ASCII letters is one piece, which goes to the library's BPE model directly, in its byte characters."""
        tokenize, space = self.tokenizer.model.tokenize, byte_characters()[32]
        out = [[t.id for t in tokenize(space + u[1:].decode())] if u[:1] == b" " and u[1:].isalpha() else None for u in units]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([units[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        whole = [bool(_OTHER_SPACE.search(t)) for t in texts]
        out = self.memory.encode([b"" if direct else t.encode() for t, direct in zip(texts, whole, strict=True)])
        for i, direct in enumerate(whole):
            if direct:
                out[i] = np.asarray(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end code point of each token."""
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(np.fromiter((len(self.bytes[i]) for i in ids.tolist()), np.int64, len(ids)))
        return character[np.concatenate([[0], ends[:-1]])[: len(ids)]], character[ends - 1] + 1


def codec(path: str, pattern: str) -> ByteCodec:
    """One for each worker process, kept between its tasks."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteCodec(path, pattern)
    return _CODECS[path, pattern]


def _map(docs: DataFrame, one, fields: str, path: str, pattern: str) -> DataFrame:
    """``one(codec, text, ids)`` gives the fields after doc_id."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            schema = None
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                texts = [t or "" for t in some.column("text").to_pylist()]
                rows = [one(coder, t, ids) for t, ids in zip(texts, coder.encode(texts), strict=True)]
                columns = [some.column("doc_id"), *[pa.array(list(c)) for c in zip(*rows, strict=True)]]
                schema = ["doc_id", *[f.split()[0] for f in fields.split(", ")]]
                yield pa.RecordBatch.from_arrays(columns, names=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {fields}")


def token_ids(docs: DataFrame, path: str, pattern: str, offsets: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of every row; with ``offsets`` also starts and ends (code points of each token) and decoded."""
    def one(coder: ByteCodec, text: str, ids: np.ndarray) -> tuple:
        back = coder.decode(ids)
        out = len(ids), ids.astype(np.int32), hashlib.sha256(back).hexdigest()
        return (*out, *(x.astype(np.int32) for x in coder.offsets(text, ids)), back.decode("utf-8", "replace")) if offsets else out

    fields = "n_tokens long, ids array<int>, decoded_sha256 string" + ", starts array<int>, ends array<int>, decoded string" * offsets
    return _map(docs, one, fields, path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    def one(coder: ByteCodec, text: str, ids: np.ndarray) -> tuple:
        listed = ",".join(map(coder.names.__getitem__, ids.tolist()))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

    return _map(docs, one, "n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern)
