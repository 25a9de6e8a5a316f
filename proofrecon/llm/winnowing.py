"""Benchmark decontamination by winnowing: minimum k-gram hashes of sliding windows, joined and extended to whole windows.

A benchmark item's windows are its runs of ``length`` words; an item of fewer words is one window of its own length.
Of a window of L words the fingerprint is the least hash of its k-grams, k = (L + 1) // 2. A span of L words that a
document and an item share holds the same k-grams in both, hence the same fingerprint: no shared window is missed.

* Benchmark: one row per distinct window with its fingerprint and 128 bits over all its words. Windows with the same
  items form one item set, so that a preamble of all items is listed once and not once a window.
* A bitmap of ``BITS`` bits, whatever the benchmark's size, tells which fingerprints occur. A fuller bitmap lets more
  document rows pass, never fewer.
* Documents: one scan computes all fingerprints; those in the bitmap are kept beside the document with their window's
  128 bits and place. That table is written; texts are read once and never shuffled.
* Join on fingerprint and window bits; a document window meets at most one benchmark window, so hits never multiply.
  Hits are extended to maximal runs of words per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofrecon.llm.common import chunks, cut, encoded
from proofrecon.llm.textarrays import joined, mix, powers, prefix, spans

#: Bytes of words: digits, lower-case letters and all of other scripts.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bits of the map of benchmark fingerprints (4 MB).
BITS = 25
_SALT = np.uint64(0xA24BAED4963EE407)
_WINDOW = ("fp", "h1", "h2", "len")


class Windows:
    """Words of many texts, and fingerprints and hashes of their windows."""

    def __init__(self, docs: list[bytes]) -> None:
        buf, starts = joined([d.lower() for d in docs])
        edge = np.flatnonzero(np.diff(_WORD[buf].astype(np.int8), prepend=0, append=0))
        begin, end = edge[::2], edge[1::2]
        self.first = np.searchsorted(begin, starts)
        self.n_words = np.diff(self.first)
        word = spans(prefix(buf), begin, end)
        self.sums = [self._summed(word), self._summed(mix(word ^ _SALT))]

    @staticmethod
    def _summed(word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * powers(len(word)), out=out[1:])
        return out

    def fingerprints(self, length: int) -> np.ndarray:
        """The least k-gram hash of the window at each word; windows that pass the end of all texts are left out."""
        k = (length + 1) // 2
        at = np.arange(max(0, len(self.sums[0]) - k))
        low = spans(self.sums[0], at, at + k)
        width, span = 1, length - k + 1
        while 2 * width <= span:
            low = np.minimum(low[: len(low) - width], low[width:]) if len(low) > width else low[:0]
            width *= 2
        rest = span - width
        return np.minimum(low[: len(low) - rest], low[rest:]) if len(low) > rest else low[:0]

    def inside(self, length: int, n: int) -> np.ndarray:
        """Which of the first ``n`` windows lie in one text."""
        left = np.repeat(self.first[1:], self.n_words)[:n] - np.arange(n)
        return left >= length

    def hashes(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        return spans(self.sums[0], at, at + length), spans(self.sums[1], at, at + length)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _item_windows(items: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            w = Windows(encoded(batch.column("text")))
            size = np.minimum(w.n_words, length)
            for n in sorted(set(size.tolist()) - {0}):
                fp = w.fingerprints(n)
                doc = np.repeat(np.arange(len(size)), w.n_words)[: len(fp)]
                at = np.flatnonzero(w.inside(n, len(fp)) & (size[doc] == n))
                h1, h2 = w.hashes(at, n)
                own = batch.column("item_id").take(pa.array(doc[at]))
                yield pa.RecordBatch.from_arrays([own, _signed(fp[at]), _signed(h1), _signed(h2), pa.array(np.full(len(at), n, np.int32))], names=["item_id", *_WINDOW])

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, fp long, h1 long, h2 long, len int")


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The bits of all fingerprints as bytes. At most 2**BITS / 64 rows come to the driver, however many windows there are."""
    slots = windows.select(F.shiftrightunsigned("fp", 64 - BITS).alias("slot"))
    rows = slots.groupBy(F.expr("cast(shiftright(slot, 6) as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    got = rows.toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def _candidates(docs: DataFrame, lengths: list[int], bitmap: np.ndarray) -> DataFrame:
    bits = docs.sparkSession.sparkContext.broadcast(bitmap)
    fields = [("start", pa.int32()), ("len", pa.int32()), ("fp", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in chunks(batches, "text"):
            w = Windows(encoded(batch.column("text")))
            doc_of = np.repeat(np.arange(batch.num_rows), w.n_words)
            found = []
            for n in lengths:
                fp = w.fingerprints(n)
                slot = (fp >> np.uint64(64 - BITS)).astype(np.int64)
                at = np.flatnonzero((table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 & w.inside(n, len(fp)))
                h1, h2 = w.hashes(at, n)
                found.append((doc_of[at], at - w.first[doc_of[at]], np.full(len(at), n), fp[at].view(np.int64), h1.view(np.int64), h2.view(np.int64)))
            columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 6
            order = np.argsort(columns[0], kind="stable")
            offsets = np.searchsorted(columns[0][order], np.arange(batch.num_rows + 1)).astype(np.int32)
            parts = [pa.array(c[order]).cast(kind) for c, (_, kind) in zip(columns[1:], fields, strict=True)]
            windows = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, names=[name for name, _ in fields]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.n_words.astype(np.int64)), windows], names=["doc_id", "n_words", "windows"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, windows array<struct<start int, len int, fp long, h1 long, h2 long>>")


def merged_spans(hits: DataFrame, key: str) -> DataFrame:
    """Per key the maximal runs of overlapping or touching [start, end) and how many places they cover."""
    before = F.max("end").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    place = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    runs = opened.withColumn("_run", F.sum("_new").over(place)).groupBy(key, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame, *, length: int = 10) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, spans, items, contaminated.

    ``items`` has item_id and text. Words are runs of 0-9, a-z and code points from 0x80, after A-Z are lower-cased.
    ``spans`` are the maximal runs of hit words, [start, end) by word; ``items`` the distinct ids, as strings and in
    string order, of items with a window in the document. Null, empty and wordless texts have no words and no hits; an
    item without words has no window. Rows that repeat a doc_id or an item_id count each; an item without an id hits
    words and is not listed. An empty benchmark leaves every document clean. Other columns are left out.
    """
    windows = cut(_item_windows(items, length).distinct())
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())
    sets = windows.where("item_id is not null").groupBy(*_WINDOW).agg(
        F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64("item_id")), F.bit_xor(F.xxhash64("item_id", F.lit(1)))).alias("items_key")
    )
    classes = cut(windows.select(*_WINDOW).distinct().join(sets, [*_WINDOW], "left"))
    first = classes.where("items_key is not null").groupBy("items_key").agg(F.min(F.struct(*_WINDOW)).alias("w")).select("items_key", "w.*")
    members = cut(windows.where("item_id is not null").join(first, [*_WINDOW]).select("items_key", "item_id"))

    scanned = cut(_candidates(docs, lengths, _bitmap(windows)).withColumn("_row", F.monotonically_increasing_id()))
    each = scanned.select("_row", F.explode("windows").alias("w")).select("_row", "w.*")
    hits = cut(each.join(classes, [*_WINDOW]).select("_row", "start", (F.col("start") + F.col("len")).alias("end"), "items_key"))
    named = hits.where("items_key is not null").select("_row", "items_key").distinct().join(members, "items_key").groupBy("_row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = scanned.drop("windows").join(merged_spans(hits, "_row"), "_row", "left").join(named, "_row", "left")
    none = F.array().cast("array<struct<start int, end int>>")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))

