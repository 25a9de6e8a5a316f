"""Frequent phrases and how strongly their words hold together, by sorted suffixes (suffix-sigma).

Texts are cut into pieces and these into words. From each word starts a suffix of at most ``longest`` words of its piece.

* Words are counted first. The ``CODED`` most frequent ones, a fixed number, get codes of two bytes; any other word is
  spelled in a suffix. Codes and spellings end by themselves, so a phrase's words are a prefix of its suffixes' bytes.
* Suffixes go to tasks by language and first word, a first word's suffixes dealt out by their second word, so that no
  frequent word is one task's work. Pairs of the about ``HOT`` most frequent words are dealt further by their third word;
  only these pairs' own counts are then sums over several tasks. A block of text counts equal suffixes once, and ships
  what goes to one bucket of pairs as one row.
* A task sorts its suffixes in descending order and counts all prefixes of at least two words with one stack of open
  runs. Prefixes that stay below ``least`` are passed over as a whole.
* Parts of phrases are joined to their counts afterwards. All arithmetic is on integers of up to 38 digits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofrecon.llm.common import chunks, cut, encoded
from proofrecon.llm.textarrays import mix, prefix, spans

#: Bytes of codes; a code doesn't begin with a point, which begins a spelled word. A comma ends that.
_SECOND = bytes(range(1, 128))
_FIRST = bytes(b for b in _SECOND if b != ord("."))
CODED = len(_FIRST) * len(_SECOND)
_WORD = re.compile(rb"\.[^,]*,|..", re.DOTALL)
#: First bytes of the codes of hot words.
_HOT_BYTES = 8
HOT = _HOT_BYTES * len(_SECOND)
#: Bytes of text in a block, and buckets of pairs: a block ships at most so many rows, and at most so many tasks count.
BLOCK, BUCKETS = 1 << 20, 4096
#: Distinct words that a task counts before it hands them on, and parts of a language when its best phrases are chosen.
WORDS, SHARES = 400_000, 64
_ENDS = b".,;:!?\n\x0b\x0c\r"
_BLANKS, _POINTS = bytes.maketrans(_ENDS, b" " * len(_ENDS)), bytes.maketrans(_ENDS, b"." * len(_ENDS))


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of each language, A-Z in lower case, a point between two."""
    langs = batch.column("lang").to_pylist()
    texts = encoded(batch.column("text"))
    for lang in sorted(set(langs)):
        yield lang, b".".join([t for t, x in zip(texts, langs, strict=True) if x == lang]).lower()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f of all words of ``docs`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for part in chunks([batch], "text"):
                for lang, text in _by_language(part):
                    counts.setdefault(lang, Counter()).update(text.translate(_BLANKS).split())
                if sum(map(len, counts.values())) > WORDS:
                    yield from told(counts)
                    counts = {}
        yield from told(counts)

    def told(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            words = pa.array(list(c), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), words, pa.array(list(c.values()), pa.int64())], names=["lang", "word", "f"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _heads(langs: list[str]) -> dict[str, bytes]:
    """What stands before the suffixes of each language: one byte, or \\xff and four more; no head begins another."""
    return {lang: bytes([n]) if n < 255 else b"\xff" + n.to_bytes(4, "big") for n, lang in enumerate(langs)}


def _held(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins, and at last where they end."""
    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] else np.zeros(0, np.uint8), at - at[0]


def _numbers(column: pa.Array, width: np.ndarray) -> np.ndarray:
    """The numbers of all rows, each of its row's ``width`` bytes."""
    data, at = _held(column)
    each = np.diff(at) // width
    w = np.repeat(width, each)
    place = np.repeat(at[:-1], each) + w * (np.arange(len(w)) - np.repeat(np.cumsum(each) - each, each))
    out = data[place].astype(np.int32)
    for k in range(1, int(width.max(initial=1))):
        wide = np.flatnonzero(w > k)
        out[wide] |= data[place[wide] + k].astype(np.int32) << np.int32(8 * k)
    return out


def _distinct(key: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes stand for their equals, in the order of ``key``, and how many each stands for; equal by 128 bits."""
    order = np.argsort(key, kind="stable")
    a, b = first[order], second[order]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return order[new], np.diff(np.append(new, len(order)))


def _gathered(head: bytes, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The spans of a buffer one after another, ``head`` before each."""
    lead = len(head)
    size = end - start + lead
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    both = np.concatenate([np.frombuffer(head, np.uint8), buf])
    return both[np.where(within < lead, within, within + np.repeat(start, size))]


def shipped_suffixes(docs: DataFrame, codes: dict[bytes, bytes], heads: dict[str, bytes], longest: int, buckets: int) -> DataFrame:
    """bucket, width, data, sizes, counts: the suffixes of two words and more of a block of text whose pairs fall into one bucket.

    data is all suffixes joined, each behind its language's head. sizes and counts have each suffix's bytes and how often
    it occurs, in numbers of ``width`` bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast({**codes, b".": b""})
    languages = docs.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value.get
        for batch in batches:
            for part in chunks([batch], "text", BLOCK):
                for lang, text in _by_language(part):
                    tokens = text.translate(_POINTS).replace(b".", b" . ").split()
                    spelled = [x if (x := code(w)) is not None else b"." + w + b"," for w in tokens]
                    size = np.fromiter(map(len, spelled), np.int64, len(spelled))
                    piece = np.cumsum(size == 0)[size > 0]
                    buf = np.frombuffer(b"".join(spelled), np.uint8)
                    del tokens, spelled
                    place = np.append(0, np.cumsum(size[size > 0]))
                    end = np.searchsorted(piece, piece, side="right")
                    at = np.flatnonzero(np.arange(len(end)) + 1 < end)
                    if not len(at):
                        continue
                    sums = [prefix(buf), prefix(buf ^ np.uint8(0x5A))]
                    start, pair, last = place[at], place[at + 2], place[np.minimum(at + longest, end[at])]
                    whole = [spans(x, start, last) for x in sums]
                    hot = (buf[start] <= _HOT_BYTES) & (buf[place[at + 1]] <= _HOT_BYTES)
                    dealt = spans(sums[0], start, np.where(hot, place[np.minimum(at + 3, end[at])], pair)) ^ np.uint64(crc32(lang.encode()))
                    bucket = mix(dealt) % np.uint64(buckets)
                    own, counts = _distinct(bucket << np.uint64(48) | whole[0] >> np.uint64(16), *whole)
                    start, last, bucket = start[own], last[own], bucket[own].astype(np.int32)
                    new = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(own))
                    head = languages.value[lang]
                    size, n = last - start + len(head), len(new) - 1
                    width = next(w for w in (1, 2, 4) if max(size.max(), counts.max()) < 256**w)
                    cut_up = lambda data, edges: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])  # noqa: B023, E731
                    number = lambda x: cut_up(x.astype(f"<u{width}"), new * width)  # noqa: B023, E731
                    data = cut_up(_gathered(head, buf, start, last), np.append(0, np.cumsum(size))[new])
                    columns = [pa.array(bucket[new[:-1]]), pa.array(np.full(n, width, np.int32)), data, number(size), number(counts)]
                    whole_batch = pa.RecordBatch.from_arrays(columns, names=["bucket", "width", "data", "sizes", "counts"])
                    for k in range(0, n, 5_000):
                        yield whole_batch.slice(k, 5_000)

    return docs.select("lang", "text").mapInArrow(run, "bucket int, width int, data binary, sizes binary, counts binary")


def unpacked_suffixes(blocks: DataFrame) -> DataFrame:
    """suffix, n of shipped blocks, a row for each suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1_000):
                part = batch.slice(k, 1_000)
                width = part.column("width").to_numpy().astype(np.int64)
                sizes, counts = (_numbers(part.column(c), width) for c in ("sizes", "counts"))
                offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
                suffix = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(_held(part.column("data"))[0])])
                yield pa.RecordBatch.from_arrays([suffix, pa.array(counts)], names=["suffix", "n"])

    return blocks.mapInArrow(run, "suffix binary, n int")


class _Depth:
    """Runs of rows with one prefix of so many words; the last run of a batch stays open for the next."""

    def __init__(self, words: int) -> None:
        self.words, self.key, self.total = words, None, 0

    def take(self, key: tuple, total: int) -> Iterator[tuple[tuple, int]]:
        """Add a run; gives the run before it once it is over."""
        if key == self.key:
            self.total += total
            return
        yield from self.close()
        self.key, self.total = key, total

    def close(self) -> Iterator[tuple[tuple, int]]:
        if self.key is not None:
            yield self.key, self.total
        self.key = None


def counted_prefixes(rows: DataFrame, codes: dict[bytes, bytes], heads: dict[str, bytes], longest: int, least: int) -> DataFrame:
    """lang, phrase (spaces between words), words, a of all prefixes of two words and more that occur ``least`` times.

    ``rows`` are sorted within partitions, descending, so that the rows of a language and a prefix are one run. The runs that are open, one
    for each number of words, are the stack: a batch adds to them, closes those that have ended, and opens others. A run
    that stays below ``least`` isn't looked into. Pairs of hot words come with whatever count this task has.
    """
    shared, languages = (rows.sparkSession.sparkContext.broadcast(x) for x in (codes, heads))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {c: w.decode() for w, c in shared.value.items()}
        named = {head: lang for lang, head in languages.value.items()}
        depths = [_Depth(n) for n in range(2, longest + 1)]
        out: list[tuple[str, str, int, int]] = []

        def tell(key: tuple, total: int, n: int) -> None:
            lang, code = named[key[0]], key[1]
            hot = n == 2 and len(code) == 4 and code[0] <= _HOT_BYTES and code[2] <= _HOT_BYTES
            if total >= least or hot:
                out.append((lang, " ".join([words.get(t) or t[1:-1].decode() for t in _WORD.findall(code)]), n, total))

        def table() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["lang", "phrase", "words", "a"])

        for batch in batches:
            if not batch.num_rows:
                continue
            data, edge = _held(batch.column("suffix"))
            buf = np.append(data, np.zeros(1, np.uint8))
            raw = data.tobytes()
            start, end, n = edge[:-1], edge[1:], batch.column("n").to_numpy().astype(np.int64)
            sums, commas = prefix(buf), np.append(np.flatnonzero(buf == ord(",")), len(buf))
            lead = np.where(buf[start] == 255, 5, 1)
            at, upto, codes_at = np.arange(len(start)), start + lead, start + lead

            def word_end(place: np.ndarray) -> np.ndarray:
                out = place + 2
                spelled = np.flatnonzero(buf[place] == ord("."))  # noqa: B023
                out[spelled] = commas[np.searchsorted(commas, place[spelled])] + 1  # noqa: B023
                return out

            upto = word_end(upto)
            for depth in depths:
                more = upto < end[at]  # the end of one more word, for rows that have one
                if not more.all():
                    at, upto = at[more], upto[more]
                upto = word_end(upto)
                if not len(at):
                    break
                key = spans(sums, start[at], upto)
                new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (lead[at[1:]] != lead[at[:-1]])))
                totals, first = np.add.reduceat(n[at], new), codes_at[at[new]]
                hot = (depth.words == 2) & (upto[new] - first == 4) & (buf[first] <= _HOT_BYTES) & (buf[first + 2] <= _HOT_BYTES)
                some = (totals >= least) | hot
                some[[0, -1]] = True  # these may go on in the next batch, or come from the last
                for k in np.flatnonzero(some).tolist():
                    row = at[new[k]]
                    for done in depth.take((raw[start[row] : codes_at[row]], raw[codes_at[row] : upto[new[k]]]), int(totals[k])):
                        tell(*done, depth.words)
                inside = np.repeat(some, np.diff(np.append(new, len(at))))
                at, upto = at[inside], upto[inside]
            if len(out) >= 5_000:
                yield table()
                out.clear()
        for depth in depths:
            for done in depth.close():
                tell(*done, depth.words)
        yield table()

    return rows.mapInArrow(run, "lang string, phrase string, words int, a long")


def collocations(docs: DataFrame, *, least: int = 100, longest: int = 5, best: int = 2000, buckets: int = BUCKETS) -> DataFrame:
    """lang, rank, phrase, words, a, l, r, n, score, at: each language's ``best`` phrases of 2 to ``longest`` words.

    ``docs`` has lang and text. Pieces end at ``. , ; : ! ?`` and \\x0A-\\x0D; words are ``[^\\x20\\x09]+``, A-Z in lower
    case. A null language is ``und``, together with a language of that name; a null, empty or wordless text adds nothing.
    a counts all occurrences of a phrase, n those of all words of the language. A phrase cut after ``at`` words has l and r,
    the counts of its parts, and score floor(1000 * a * n / (l * r)); the lowest cut counts, then the first. A phrase
    inside a longer one that occurs as often is left out. Ranks go by score, a (descending) and phrase (bytes). Repeated
    rows count each; other columns are left out. More ``buckets`` give a larger cluster more tasks, and shorter shipped rows.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = cut(word_counts(docs))
    total = cut(words.groupBy("lang").agg(F.sum("f").alias("n")))
    often = cut(words.where(F.col("f") >= least))
    top = often.groupBy("word").agg(F.sum("f").alias("f")).orderBy(F.desc("f"), "word").limit(CODED).select("word").toArrow()
    names = (bytes([x, y]) for x in _FIRST for y in _SECOND)
    codes = dict(zip(encoded(top.column("word").combine_chunks()), names, strict=False))

    heads = _heads(total.orderBy("lang").select("lang").toArrow().column(0).to_pylist())

    blocks = shipped_suffixes(docs, codes, heads, longest, buckets).repartition("bucket")
    dealt = unpacked_suffixes(blocks).sortWithinPartitions(F.desc("suffix"))
    parts = counted_prefixes(dealt, codes, heads, longest, least).groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))
    found = cut(parts.where(F.col("a") >= least))

    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("at"))
    upto = lambda k: F.call_function("substring_index", F.col("phrase"), F.lit(" "), k)
    cuts = cuts.withColumn("_l", upto(F.col("at"))).withColumn("_r", upto(F.col("at") - F.col("words")))
    single = often.select("lang", F.col("word").alias("part"), "f")
    known = cut(single.unionByName(found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))))
    cuts = cuts.join(known.select("lang", F.col("part").alias("_l"), F.col("f").alias("l")), ["lang", "_l"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("_r"), F.col("f").alias("r")), ["lang", "_r"])
    cuts = cuts.join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "at", "l", "r")).alias("c"))

    inner = found.where("words > 2").select("lang", "a", F.explode(F.array(upto(F.col("words") - 1), upto(1 - F.col("words")))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (F.col("_longer") < F.col("a")))
    kept = kept.select("lang", "phrase", "words", "a", "n", "c.*")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    first = kept.withColumn("_share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("rank") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score", F.col("at").cast("long").alias("at"))
