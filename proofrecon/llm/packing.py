"""Pack documents into token sequences along a space-filling curve.

A document's ids give a hashed vector, projected to a few dimensions; its place on the Hilbert curve through them is its
key. Documents are range-partitioned and sorted by key, and each partition cuts the run of its documents' ids into
sequences, so that neighbours on the curve share a sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from proofrecon.llm.common import chunks, cut
from proofrecon.llm.tokens import encoder

#: Dimensions of the hashed vectors and of the curve, and bits of each of its coordinates.
HASHED, DIMENSIONS, BITS = 64, 4, 15


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of unsigned integer points (rows) with ``bits`` bits a coordinate.

    The axes become the transposed index by one inverse undo pass and a Gray encoding; its bits are interleaved.
    """
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[:, i] & q) > 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(on, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[:, n - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The curve place of each document: ids hashed to signed counts, damped, projected, scaled to the unit sphere."""
    rng = np.random.default_rng(31)
    slot, sign = rng.integers(0, HASHED, 1 << 16), rng.choice([-1.0, 1.0], 1 << 16)
    projection = rng.standard_normal((HASHED, DIMENSIONS))
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(doc * HASHED + slot[ids], sign[ids], n * HASHED).reshape(n, HASHED)
    point = (np.sign(counts) * np.log1p(np.abs(counts))) @ projection
    point /= np.maximum(np.linalg.norm(point, axis=1, keepdims=True), 1e-9)
    return hilbert_keys(((point + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64), BITS)


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text): doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by ``tokenizer`` (a file of the tokenizers library with ids under 65,536) and ``end_id``; null
    is empty. Every id is in exactly one piece. A sequence holds ``length`` ids, but the last ids of a partition form
    sequences whose lengths are powers of two, so nothing is padded. Documents with equal keys lie in doc_id order; rows
    that repeat a doc_id are packed each. ids holds 32-bit little-endian integers, ids_crc32 their CRC-32. sequence_id
    has the partition in its upper bits.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in chunks(batches, "text", 2 << 20):
            ids, at = code.encode(batch.column("text"))
            own = [np.append(ids[a:b], np.uint16(end_id)).astype("<u2").tobytes() for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(curve_keys(ids, at)), pa.array(own, pa.binary())], names=["doc_id", "key", "ids"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        open_pieces: list[tuple] = []
        fill = 0

        def emit(pieces: list[tuple], sequence: int) -> list[tuple]:
            out, offset = [], 0
            for doc_id, start, ids, total in pieces:
                raw = ids.astype("<u4").tobytes()
                out.append((doc_id, start, len(ids), raw, zlib.crc32(raw), total, sequence, offset))
                offset += len(ids)
            return out

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[] for _ in _PACKED]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)

        for batch in batches:
            found = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids, start = np.frombuffer(raw, "<u2"), 0
                while start < len(ids):
                    part = ids[start : start + length - fill]
                    open_pieces.append((doc_id, start, part, len(ids)))
                    start, fill = start + len(part), fill + len(part)
                    if fill == length:
                        found += emit(open_pieces, number)
                        open_pieces, fill, number = [], 0, number + 1
            yield rows(found)
        found = []
        while fill:
            room, taken, left = 1 << (fill.bit_length() - 1), [], []
            fill -= room
            for doc_id, start, ids, total in open_pieces:
                if room:
                    taken.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    left.append((doc_id, start + room, ids[room:], total))
                room = max(0, room - len(ids))
            found += emit(taken, number)
            open_pieces, number = left, number + 1
        yield rows(found)

    table = cut(docs.select("doc_id", "text").mapInArrow(keyed, "doc_id long, key long, ids binary"))
    placed = table.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return placed.mapInArrow(packed, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


_PACKED = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    + [(name, pa.int64()) for name in ("ids_crc32", "doc_tokens", "sequence_id", "offset")]
)
