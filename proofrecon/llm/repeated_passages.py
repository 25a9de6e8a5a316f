"""Exact removal of byte passages that occur elsewhere: a depth-limited radix ordering of suffixes.

Suffixes are told apart only through their first ``length`` bytes, in most-significant-digit passes; groups that are
left at full depth are exactly the repeated windows.

* First digit: of each window the ``digit`` bytes at its anchor, the place in it where these bytes hash lowest (leftmost
  of equals). Equal windows have equal anchors at equal places, so windows whose anchor bytes occur once drop out.
  Neighbouring windows with one anchor form a run; a run is one row.
* Second digit: the bytes under a whole run. Where all runs of an anchor agree, all their windows repeat.
* Third digit: where they differ, one run of each kind is cut into blocks of at most ``GRID`` windows on a grid at the
  anchor. All windows of a grid block share ``length - GRID + 1`` bytes; blocks that share them with no other drop out.
* Last digit: of what is left, windows are told apart by all ``length`` bytes where whole blocks differ.

Groups carry the digits' hashes together (128 bits and more). Texts are joined twice at any size: once to cut out the
bytes under one run of each kind, from which the later digits are read, and once to remove what was found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofrecon.llm.common import chunks, cut, encoded
from proofrecon.llm.textarrays import joined, mix, prefix, spans


def anchored_runs(docs: list[bytes], length: int, digit: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: doc, first and last window start (in the document), anchor less first, hashes."""
    buf, starts = joined(docs)
    sums = prefix(buf)
    span = length - digit + 1
    sizes = np.diff(starts) - 1
    none = np.zeros(0, np.int64)
    if len(buf) < length or not (sizes >= length).any():
        return {k: none for k in ("doc", "first", "last", "lead", "anchor", "bytes")}
    at = np.arange(len(buf) - digit + 1)
    hashes = spans(sums, at, at + digit)
    bits = max(1, int(len(buf)).bit_length())
    low = (hashes >> np.uint64(bits)) << np.uint64(bits) | at.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    anchor = (low & np.uint64((1 << bits) - 1)).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, np.int64)
    for d in np.flatnonzero(sizes >= length).tolist():
        valid[starts[d] : starts[d] + sizes[d] - length + 1] = d + 1
    change = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(valid[:-1], prepend=0) != 0))
    last = np.append(change[1:], len(anchor)) - 1
    some = valid[change] > 0
    first, last = change[some], last[some]
    doc, anchor = valid[first] - 1, anchor[first]
    lead = anchor - first
    under = mix(spans(sums, first, last + length) + lead.astype(np.uint64))
    return {"doc": doc, "first": first - starts[doc], "last": last - starts[doc], "lead": lead, "anchor": hashes[anchor], "bytes": under}


def _runs(docs: DataFrame, length: int, digit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            r = anchored_runs(encoded(batch.column("text")), length, digit)
            own = [batch.column(c).take(pa.array(r["doc"])) for c in ("doc_id", "content")]
            made = [pa.array(r[c].astype(np.uint64).view(np.int64)) for c in ("anchor", "bytes")]
            made += [pa.array(r[c].astype(np.int32)) for c in ("first", "last", "lead")]
            yield pa.RecordBatch.from_arrays([*own, *made], names=["doc_id", "content", "anchor", "bytes", "first", "last", "lead"])

    return docs.mapInArrow(run, "doc_id long, content long, anchor long, bytes long, first int, last int, lead int")


#: Windows in a grid block.
GRID = 8


def _kind_bytes(rows: DataFrame, length: int) -> DataFrame:
    """The bytes under each listed run of a text, with the run's anchor, place and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            docs, lists = encoded(batch.column("text")), batch.column("runs")
            doc = np.repeat(np.arange(len(docs)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            runs = lists.flatten()
            first, last = (runs.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("first", "last"))
            under = [docs[d][a : b + length] for d, a, b in zip(doc.tolist(), first, last, strict=True)]
            own = [batch.column(c).take(pa.array(doc)) for c in ("doc_id", "content")]
            for part in range(0, len(under), 4096):  # small batches, whatever a document holds
                made = [*(x.slice(part, 4096) for x in own), *(runs.field(c).slice(part, 4096) for c in _RUN), pa.array(under[part : part + 4096], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "content", *_RUN, "under"])

    return rows.mapInArrow(run, "doc_id long, content long, anchor long, bytes long, first int, last int, lead int, n long, under binary")


_RUN = ["anchor", "bytes", "first", "last", "lead", "n"]


def _under(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Prefix sums over the bytes of all rows, where each row's bytes begin, and first, last, lead, n."""
    buf, starts = joined(encoded(batch.column("under")))
    return prefix(buf), starts, [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "last", "lead", "n")]


def _blocks(rows: DataFrame, length: int) -> DataFrame:
    """One row per grid block of the runs (with the bytes under them), with the hashes of what its windows share and cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "under"):
            sums, starts, (first, last, lead, n) = _under(batch)
            least = lead - (last - first)
            count = lead // GRID - least // GRID + 1
            which = np.repeat(np.arange(len(count)), count)
            block = least[which] // GRID + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            high, low = np.minimum(lead[which], block * GRID + GRID - 1), np.maximum(least[which], block * GRID)
            at = first[which] + lead[which]
            base = starts[which] + lead[which]
            core = spans(sums, base - block * GRID, base - block * GRID + length - GRID + 1)
            under = mix(spans(sums, base - high, base - low + length) + high.astype(np.uint64))
            own = [batch.column(c).take(pa.array(which)) for c in ("doc_id", "content", "anchor", "bytes")]
            made = [pa.array(block.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(under.view(np.int64))]
            made += [pa.array(x.astype(np.int32)) for x in (at - high, at - low, high)]
            yield pa.RecordBatch.from_arrays([*own, *made, pa.array(n[which] == 1)], names=_BLOCK)

    return rows.mapInArrow(run, "doc_id long, content long, anchor long, run long, block int, core long, bytes long, first int, last int, lead int, alone boolean")


_BLOCK = ["doc_id", "content", "anchor", "run", "block", "core", "bytes", "first", "last", "lead", "alone"]


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """One row per window from first to last of a run that begins at run_first: anchor, hash of the window and its place at the anchor, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "under"):
            sums, starts, (first, last, lead, n) = _under(batch)
            inside = first - batch.column("run_first").to_numpy().astype(np.int64)
            size = last - first + 1
            which = np.repeat(np.arange(len(size)), size)
            step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            place = starts[which] + inside[which] + step
            window = mix(spans(sums, place, place + length) + (lead[which] - step).astype(np.uint64))
            own = [batch.column(c).take(pa.array(which)) for c in ("doc_id", "content", "anchor")]
            made = [pa.array(window.view(np.int64)), pa.array((first[which] + step).astype(np.int32)), pa.array(n[which] == 1)]
            yield pa.RecordBatch.from_arrays([*own, *made], names=["doc_id", "content", "anchor", "window", "start", "alone"])

    return rows.mapInArrow(run, "doc_id long, content long, anchor long, window long, start int, alone boolean")


def _cleaned(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            out = []
            for text, found in zip(encoded(batch.column("text")), batch.column("found").to_pylist(), strict=True):
                gone, end = [], -1
                for f in sorted(found or (), key=lambda f: f["first"]):
                    if f["first"] > end:
                        gone.append([f["first"], f["last"] + length])
                    else:
                        gone[-1][1] = max(end, f["last"] + length)
                    end = gone[-1][1]
                kept, at = [], 0
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            made = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _among(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``found``, an aggregate by ``on`` that is written first: within the join's own stage it would
    bind the rows of a common passage to one task, and Spark could not split them."""
    return rows.join(cut(found), on)


def repeated_spans(docs: DataFrame, *, length: int = 400, digit: int = 150) -> DataFrame:
    """Runs of repeated windows: doc_id, content, first and last start; a run may be listed more than once.

    ``docs`` has doc_id, text and content (a hash of the text, so that rows that share a doc_id stay apart).
    """
    key = ["doc_id", "content"]
    runs = cut(_runs(docs, length, digit))
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("bytes").alias("a"), F.max("bytes").alias("b"))
    anchors = anchors.where("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed"))
    live = cut(_among(runs, anchors, ["anchor"]))

    place = [*key, "first", "last"]
    whole = live.where("not mixed").select(*place)
    one = F.min(F.struct("doc_id", "content", "first", "last", "lead")).alias("one")
    kinds = cut(live.where("mixed").groupBy("anchor", "bytes").agg(F.count("*").alias("n"), one))
    several = kinds.where("n > 1").select("anchor", "bytes")
    whole = whole.unionByName(live.where("mixed").join(several, ["anchor", "bytes"]).select(*place))

    opened = kinds.groupBy("one.doc_id", "one.content").agg(F.collect_list(F.struct("anchor", "bytes", "one.first", "one.last", "one.lead", "n")).alias("runs"))
    held = cut(_kind_bytes(_with_texts(docs, opened, "inner").select(*key, "text", "runs"), length))

    blocks = cut(_blocks(held, length))
    core = ["anchor", "block", "core"]
    shared = blocks.groupBy(*core).agg(F.count("*").alias("n"), F.min("bytes").alias("a"), F.max("bytes").alias("b"))
    shared = shared.where("n > 1").select(*core, (F.col("a") != F.col("b")).alias("mixed"))
    blocks = cut(_among(blocks, shared, core))
    whole = whole.unionByName(blocks.where("not mixed and alone").select(*place))
    one = F.min(F.struct("run", "first", "last", "lead")).alias("one")
    kinds = cut(blocks.where("mixed").groupBy(*core, "bytes").agg(F.count("*").alias("n"), one, F.min("alone").alias("alone")))
    several = kinds.where("n > 1").select(*core, "bytes")
    whole = whole.unionByName(blocks.where("mixed and alone").join(several, [*core, "bytes"]).select(*place))

    judged = F.when((F.col("n") == 1) & F.col("alone"), F.lit(1)).otherwise(F.lit(2)).cast("long")
    asked = kinds.select("anchor", F.col("one.run").alias("bytes"), *(F.col(f"one.{c}") for c in ("first", "last", "lead")), judged.alias("n"))
    under = held.select("anchor", "bytes", *key, F.col("first").alias("run_first"), "under").dropDuplicates(["anchor", "bytes"])
    windows = cut(_windows(asked.join(under, ["anchor", "bytes"]), length))
    again = windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window")
    single = _among(windows.where("alone"), again, ["anchor", "window"]).select(*key, F.col("start").alias("first"), F.col("start").alias("last"))
    return whole.unionByName(single)


def _with_texts(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``docs`` with what ``lists`` has for their (doc_id, content); the same sort-merge join at any size."""
    lists = lists.withColumnsRenamed({"doc_id": "_d", "content": "_c"}).hint("merge")
    return docs.join(lists, docs["doc_id"].eqNullSafe(lists["_d"]) & (docs["content"] == lists["_c"]), how)


def remove_repeats(docs: DataFrame, *, length: int = 400, digit: int = 150) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of ``length`` bytes that covers it also starts anywhere
    else, in this row or another; matches never cross rows, overlaps count, and strings are judged on the input. Texts
    shorter than ``length`` lose nothing. Rows that repeat a text repeat all of it; a null doc_id is a row like others.
    Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("content"))
    found = repeated_spans(docs, length=length, digit=digit)
    found = cut(found.groupBy("doc_id", "content").agg(F.collect_set(F.struct("first", "last")).alias("found")))
    return _cleaned(_with_texts(docs, found, "left").select("doc_id", "text", "found"), length)
