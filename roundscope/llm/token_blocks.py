"""Token ids as patched frame-of-reference blocks.

A file row is a segment of whole documents.  Its payload is self-describing:

    magic "PFR1", ids, ids per block, blocks        4 bytes and three unsigned 32-bit integers
    block index                                     start of each block and the end, unsigned 32-bit
    each block: minimum (u32), width (u8), exceptions (u32), packed low bits of (id - minimum),
                positions (u32 each) and high bits (u32 each) of the exceptions

The width is that of the offset at a chosen percentile; larger offsets keep their low bits in place and their high
bits in the exception list.  The block index lets a reader decode any id range without the blocks before it.
Segments are rows of Parquet files that Spark's committer writes, so a lost executor leaves no half-written file.

Null text counts as empty, so such a document holds the end id only.  Rows with one id are separate documents in any
order.  A null id comes first.  An empty table gives no rows.  Other columns are ignored.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import stored, tasks, text_or_empty
from .word_encoder import WordEncoder

BLOCK, PERCENTILE, SEGMENT = 1024, 0.98, 1 << 17
_HEAD, _BLOCK_HEAD = struct.Struct("<4sIII"), struct.Struct("<IBI")
FILE_SCHEMA = "part int, seq int, before long, tokens long, doc_ids array<long>, lengths array<long>, payload binary"
_ENCODERS: dict[str, WordEncoder] = {}
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}  # widths of whole bytes


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of each unsigned value below 2^32."""
    return np.frexp(x.astype(np.float64))[1]


def _pack(offsets: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 g values as rows of ``width`` g words: value k of 64 fills the bits from ``width`` k on."""
    rows = len(offsets)
    if width in _WHOLE:
        return offsets.astype(_WHOLE[width]).view("<u8")
    values = offsets.reshape(rows, -1, 64).astype(np.uint64) & np.uint64((1 << width) - 1)
    out = np.zeros((rows, values.shape[1], width), "<u8")
    for k in range(64):
        word, shift = divmod(k * width, 64)
        if width:
            out[:, :, word] |= values[:, :, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= values[:, :, k] >> np.uint64(64 - shift)
    return out.reshape(rows, -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The values of rows that ``_pack`` made."""
    rows = len(words)
    if width in _WHOLE:
        return words.view(_WHOLE[width]).astype(np.uint64)
    words = words.reshape(rows, -1, width) if width else np.zeros((rows, 0, 0), np.uint64)
    out = np.zeros((rows, words.shape[1], 64), np.uint64)
    for k in range(64 if width else 0):
        word, shift = divmod(k * width, 64)
        out[:, :, k] = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, :, k] |= words[:, :, word + 1] << np.uint64(64 - shift)
    return out.reshape(rows, -1) & np.uint64((1 << width) - 1)


def _block_data(ids: np.ndarray, percentile: float) -> list[bytes]:
    """Rows of blocks of one size as bytes; blocks of one width are packed together."""
    size = ids.shape[1]
    least = ids.min(axis=1)
    offsets = (ids - least[:, None]).astype(np.uint64)
    rank = max(0, int(np.ceil(percentile * size)) - 1)
    widths = _bits(np.partition(offsets, rank, axis=1)[:, rank])
    spare = np.zeros((len(ids), -size % 64), np.uint64)
    out: list[bytes] = [b""] * len(ids)
    for width in np.unique(widths).tolist():
        some = np.flatnonzero(widths == width)
        packed = _pack(np.hstack([offsets[some], spare[some]]), width).view(np.uint8).reshape(len(some), -1)[:, : (size * width + 7) // 8]
        high = offsets[some] >> np.uint64(width)
        row, place = np.nonzero(high)
        high, cuts = high[row, place].astype("<u4"), np.searchsorted(row, np.arange(len(some) + 1))
        place = place.astype("<u4")
        for i, b in enumerate(some.tolist()):
            over = slice(cuts[i], cuts[i + 1])
            out[b] = b"".join((_BLOCK_HEAD.pack(int(least[b]), width, int(cuts[i + 1] - cuts[i])), packed[i].tobytes(), place[over].tobytes(), high[over].tobytes()))
    return out


def write_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """Ids (below 2^32) as a payload; no ids give a header without blocks."""
    ids = ids.astype(np.uint32)
    whole = len(ids) // block * block
    parts = [x for some in (ids[:whole].reshape(-1, block), ids[whole:].reshape(1, -1)) if some.size for x in _block_data(some, percentile)]
    index = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]).astype("<u4").tobytes()
    return _HEAD.pack(b"PFR1", len(ids), block, len(parts)) + index + b"".join(parts)


def read_blocks(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop; only the blocks that hold them are decoded."""
    magic, n, block, blocks = _HEAD.unpack_from(payload)
    if magic != b"PFR1":
        raise ValueError("not a block payload")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, np.uint32)
    index = np.frombuffer(payload, "<u4", blocks + 1, _HEAD.size)
    body = memoryview(payload)[_HEAD.size + index.nbytes :]
    chosen = range(start // block, (stop - 1) // block + 1)
    out: list[np.ndarray] = [index] * len(chosen)
    alike: dict[tuple[int, int], list[int]] = {}
    for b in chosen:  # blocks of one size and width are unpacked together
        alike.setdefault((min(block, n - b * block), body[index[b] + 4]), []).append(b)
    for (size, width), some in alike.items():
        packed, words = (size * width + 7) // 8, (size + 63) // 64 * width
        rows = np.zeros((len(some), 8 * words), np.uint8)
        for i, b in enumerate(some):
            rows[i, :packed] = np.frombuffer(body, np.uint8, packed, index[b] + _BLOCK_HEAD.size)
        offsets = _unpack(rows.view("<u8"), width)[:, :size] if width else np.zeros((len(some), size), np.uint64)
        for i, b in enumerate(some):
            least, _, over = _BLOCK_HEAD.unpack_from(body, index[b])
            tail = index[b] + _BLOCK_HEAD.size + packed
            at = np.frombuffer(body, "<u4", over, tail)
            offsets[i, at] |= np.frombuffer(body, "<u4", over, tail + 4 * over).astype(np.uint64) << np.uint64(width)
            out[b - chosen.start] = (offsets[i] + np.uint64(least)).astype(np.uint32)
    first = start // block * block
    return np.concatenate(out)[start - first : stop - first]


def _segments(tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:  # one for each worker process, kept between its tasks
            _ENCODERS[tokenizer] = WordEncoder(tokenizer)
        encoder = _ENCODERS[tokenizer]
        end = np.asarray([end_id], encoder.dtype)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs, held, size = [], [], 0

        def row() -> pa.RecordBatch:
            lengths = [len(x) + 1 for x in held]
            payload = write_blocks(np.concatenate([y for x in held for y in (x, end)]))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([sum(lengths)], pa.int64()),
                 pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["part", "seq", "before", "tokens", "doc_ids", "lengths", "payload"])

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i in range(0, len(ids), 1024):
                for doc, x in zip(ids[i : i + 1024], encoder.encode(texts[i : i + 1024].to_pylist()), strict=True):
                    docs.append(doc)
                    held.append(x)
                    size += len(x) + 1
                    if size >= SEGMENT:
                        yield row()
                        seq, before, docs, held, size = seq + 1, before + size, [], [], 0
        if docs:
            yield row()

    return write


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encode all texts and write them in ascending doc_id order; returns the files, read back (FILE_SCHEMA).

    ``part`` numbers the doc_id ranges in order, ``before`` counts the ids of a part that precede the segment.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = ordered.repartitionByRange(tasks(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    return stored(ordered.mapInArrow(_segments(tokenizer, end_id), FILE_SCHEMA), "token_blocks")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for r in batch.to_pylist():
            ids = read_blocks(r["payload"]).astype("<u4")
            lengths = np.asarray(r["lengths"], np.int64)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + (r["base"] + r["before"])), pa.array(lengths), pa.array(sums, pa.int64())], names=names)


def describe_token_files(files: DataFrame) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers).

    The broadcast table has one row for each range part, which is the number of tasks that wrote the files.
    """
    parts = files.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("base"))
    return files.join(F.broadcast(parts), "part").select("base", "before", "doc_ids", "lengths", "payload").mapInArrow(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
