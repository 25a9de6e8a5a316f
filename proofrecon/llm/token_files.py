"""Token ids in files of Simple-8b words.

A 64-bit word has a selector in its upper four bits that says how many ids the other 60 bits hold and how wide each is.
An id of over 60 bits is an escape word and the id as the next word. Ids are cut into blocks of ``BLOCK``; words never
cross a block, and each block's first word is noted, so blocks decode alone and all words of a selector at once.

A file is a Parquet file of segments, in ascending order of doc_id: doc_ids and lengths of some documents, the words of
their ids, and the block offsets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofrecon.llm.common import chunks
from proofrecon.llm.tokens import encoder

#: Fixed values of the coding: by selector, ids in a word and bits of each.
LAYOUT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
BLOCK = 1024


#: Bits of each 16-bit number; 0 takes one.
_BITS = np.maximum(np.ceil(np.log2(np.arange(1 << 16) + 1)), 1).astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, at least one."""
    out = _BITS[ids & np.uint64(0xFFFF)]
    for low in (16, 32, 48):
        over = np.flatnonzero(ids >> np.uint64(low))
        if len(over):
            out[over] = _BITS[(ids[over] >> np.uint64(low)) & np.uint64(0xFFFF)] + low
    return out


def simple8b(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of unsigned 64-bit ids, and each block's first word's index, with the number of words at last.

    Every place gets the selector that a word which begins there would have; then all blocks step from word to word
    together.
    """
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    widest = {1: np.append(_widths(ids), np.ones(64, np.uint8))}
    while (k := max(widest)) < 32:
        widest[2 * k] = np.maximum(widest[k], np.append(widest[k][k:], np.full(k, 255, np.uint8)))
    blocks = np.arange(0, n, BLOCK)
    room = np.tile(np.arange(BLOCK, 0, -1, dtype=np.int16), len(blocks))[:n]
    room[blocks[-1] :] = np.arange(n - blocks[-1], 0, -1)
    selector = np.full(n, ESCAPE, np.uint8)
    for s in range(len(LAYOUT) - 1, -1, -1):
        count, bits = LAYOUT[s]
        k = 1 << (count.bit_length() - 1)
        most = np.maximum(widest[k][:n], widest[k][count - k : count - k + n])
        selector[(most <= bits) & (room >= count)] = s
    counts = np.array([c for c, _ in LAYOUT] + [0, 1])
    begins, here, ends = np.zeros(n, bool), blocks, np.append(blocks[1:], n)
    while len(here):
        begins[here] = True
        here = here + counts[selector[here]]
        on = here < ends
        here, ends = here[on], ends[on]
    at = np.flatnonzero(begins)
    chosen = selector[at]
    escaped = chosen == ESCAPE
    place = np.cumsum(1 + escaped) - 1 - escaped
    words = np.zeros(int(place[-1]) + 1 + int(escaped[-1]), np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(LAYOUT):
        own = np.flatnonzero(chosen == s)
        if len(own):
            packed = words[place[own]]
            for j in range(count):
                packed |= ids[at[own] + j] << np.uint64(j * bits)
            words[place[own]] = packed
    own = np.flatnonzero(escaped)
    words[place[own] + 1] = ids[at[own]]
    return words, np.append(place[np.searchsorted(at, blocks)], len(words))


def decoded(words: np.ndarray) -> np.ndarray:
    """The ids of a run of whole blocks."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == ESCAPE).any():  # what follows an escape is an id, whatever its upper bits
        raw, k = np.zeros(len(words), bool), 0
        for k in np.flatnonzero(selector == ESCAPE).tolist():
            if not raw[k]:
                raw[k + 1] = True
        heads = np.flatnonzero(~raw)
    else:
        heads = np.arange(len(words))
    chosen = selector[heads]
    counts = np.array([c for c, _ in LAYOUT] + [0, 1])[chosen]
    at = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), np.uint64)
    for s, (count, bits) in enumerate(LAYOUT):
        own = np.flatnonzero(chosen == s)
        for j in range(count if len(own) else 0):
            ids[at[own] + j] = (words[heads[own]] >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    own = np.flatnonzero(chosen == ESCAPE)
    ids[at[own]] = words[heads[own] + 1]
    return ids


def decoded_blocks(words: np.ndarray, offsets: np.ndarray, first: int, last: int) -> np.ndarray:
    """The ids of blocks first to last - 1 only."""
    return decoded(words[offsets[first] : offsets[last]])


_SEGMENT = "part int, segment int, start long, n_ids long, doc_ids binary, null_ids binary, lengths binary, words binary, blocks binary"


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 0) -> None:
    """Encode ``docs`` (doc_id, text) and write the files to ``path``, in ascending order of doc_id (null first).

    A null text is empty; ``end_id`` ends each document. Rows that repeat a doc_id lie next to each other, by text.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for k, batch in enumerate(chunks(batches, "text", 2 << 20)):
            ids, at = code.encode(batch.column("text"))
            ids = np.insert(ids, at[1:], end_id)
            lengths = np.diff(at) + 1
            words, blocks = simple8b(ids)
            doc_ids = batch.column("doc_id")
            binary = [
                doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"),
                np.packbits(doc_ids.is_null().to_numpy(zero_copy_only=False)),
                lengths.astype("<i8"),
                words.astype("<u8"),
                blocks.astype("<u4"),
            ]
            row = [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([start]), pa.array([len(ids)])]
            row += [pa.array([x.tobytes()], pa.binary()) for x in binary]
            yield pa.RecordBatch.from_arrays(row, names=[c.split()[0] for c in _SEGMENT.split(", ")])
            start += len(ids)

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(segments, _SEGMENT).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    The files' id counts, one number each, are summed up on the driver to give every file its start.
    """
    files = spark.read.schema(_SEGMENT).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = [0, *accumulate(n for _, n in totals)]
    # one row per file
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before, strict=False)], "part int, base long")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decoded(np.frombuffer(row["words"], "<u8")).astype("<u4")
                lengths = np.frombuffer(row["lengths"], "<i8")
                ends = np.cumsum(lengths)
                raw = [ids[b - n : b].tobytes() for b, n in zip(ends, lengths, strict=True)]
                null = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8))[: len(lengths)].astype(bool)
                made = [
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=null),
                    pa.array(row["base"] + row["start"] + ends - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                ]
                made += [pa.array(raw, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(made)])

    placed = files.join(F.broadcast(bases), "part").select("base", "start", "doc_ids", "null_ids", "lengths", "words")
    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit numbers) of the documents of a given list, each as often as it is stored.

    Of a segment only the blocks that hold a wanted document are decoded, found by the segment's block offsets.
    """
    wanted = np.array(sorted(set(doc_ids)), "<i8")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, blocks = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["blocks"], "<u4").astype(np.int64)
                lengths = np.frombuffer(row["lengths"], "<i8")
                ends = np.cumsum(lengths)
                names = np.frombuffer(row["doc_ids"], "<i8")
                null = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8))[: len(names)].astype(bool)
                at = np.flatnonzero(np.isin(names, wanted) & ~null)
                raw = []
                for k in at.tolist():
                    start, end = int(ends[k] - lengths[k]), int(ends[k])
                    first, last = start // BLOCK, -(-end // BLOCK)
                    ids = decoded_blocks(words, blocks, first, last)
                    raw.append(ids[start - first * BLOCK : end - first * BLOCK].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(raw, pa.binary())], names=["doc_id", "ids"])

    files = spark.read.schema(_SEGMENT).parquet(path).select("doc_ids", "null_ids", "lengths", "words", "blocks")
    return files.mapInArrow(documents, "doc_id long, ids binary")
