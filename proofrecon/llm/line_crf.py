"""Quality rules by line labelling: a linear-chain conditional random field marks each line as content or boilerplate.

Labels are known per document, so lines get weak ones first: a model of single lines, fitted to their documents' labels,
marks each line by itself, within what the document's label allows. The field is fitted to these sequences, in which
labels do change. Viterbi decoding finds the best label sequence of all lines of a document; the share of words in
content lines decides whether it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofrecon.llm.common import chunks, encoded
from proofrecon.llm.textstats import OFFSETS, text_stats

#: Documented bound of the labelled rows that the field is fitted to: those whose doc_id hashes lowest.
SAMPLE = 3000
#: A training sequence has at most so many lines, and a document gives at most so many sequences, evenly spread over it:
#: the sample's lines are bounded like its documents. Decoding has no such bounds.
SEQUENCE, SEQUENCES = 48, 4
#: A document is kept if at least this share of its words is in content lines.
CONTENT = 0.5


@dataclass(frozen=True)
class LineField:
    """emit: weight of each feature code for content; step[a, b]: from label a to b; begin: of the first label."""

    emit: np.ndarray
    step: np.ndarray
    begin: np.ndarray


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], *, rounds: int = 60, rate: float = 0.2, ridge: float = 1e-3) -> LineField:
    """Maximum likelihood by gradient ascent with forward-backward, all sequences in step.

    ``sequences``: feature codes (lines x features); ``labels``: 0 or 1 for each line.
    """
    n, t, k = len(sequences), max(map(len, sequences), default=1), len(OFFSETS) - 1
    codes, gold, live = np.zeros((n, t, k), np.int64), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for i, (s, y) in enumerate(zip(sequences, labels, strict=True)):
        codes[i, : len(s)], gold[i, : len(s)], live[i, : len(s)] = s, y, True
    size, total = int(OFFSETS[-1]), max(int(live.sum()), 1)
    pairs = live[:, 1:]
    seen_emit = np.bincount(codes[live & (gold == 1)].ravel(), minlength=size).astype(float)
    seen_step = np.bincount((gold[:, :-1] * 2 + gold[:, 1:])[pairs], minlength=4).astype(float).reshape(2, 2)
    seen_begin = np.bincount(gold[live[:, 0], 0], minlength=2).astype(float)
    theta = np.zeros(size + 6)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        emit, step, begin = theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
        score = np.zeros((n, t, 2))
        score[:, :, 1] = emit[codes].sum(axis=2)
        ahead, back = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        ahead[:, 0] = begin + score[:, 0]
        for j in range(1, t):
            into = np.logaddexp(ahead[:, j - 1, :1] + step[0], ahead[:, j - 1, 1:] + step[1]) + score[:, j]
            ahead[:, j] = np.where(live[:, j, None], into, ahead[:, j - 1])
        for j in range(t - 2, -1, -1):
            out = step[None] + (score[:, j + 1] + back[:, j + 1])[:, None, :]
            back[:, j] = np.where(live[:, j + 1, None], np.logaddexp(out[:, :, 0], out[:, :, 1]), back[:, j + 1])
        norm = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        content = np.where(live, np.exp(ahead[:, :, 1] + back[:, :, 1] - norm[:, None]), 0)
        both = np.exp(ahead[:, :-1, :, None] + step + (score[:, 1:] + back[:, 1:])[:, :, None, :] - norm[:, None, None, None])
        grad_emit = seen_emit - np.bincount(codes.ravel(), np.repeat(content.ravel(), k), size)
        grad_step = seen_step - (both * pairs[:, :, None, None]).sum(axis=(0, 1))
        first = np.exp(ahead[:, 0] + back[:, 0] - norm[:, None])[live[:, 0]].sum(axis=0)
        grad = np.concatenate([grad_emit, grad_step.ravel(), seen_begin - first]) / total - ridge * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta = theta + rate * (mean / (1 - 0.9**r)) / (np.sqrt(square / (1 - 0.99**r)) + 1e-8)
    return LineField(theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :])


def line_labels(sequences: list[np.ndarray], words: list[np.ndarray], quality: list[int], *, content: float = CONTENT) -> list[np.ndarray]:
    """Weak labels of each sequence's lines (feature codes, word counts) from its document's quality (1 or other).

    A line is content where a model of single lines says so. A sequence of a good document whose content lines then hold
    less than ``content`` of its words is content throughout; one of another document that reaches it has none.
    """
    codes = np.concatenate(sequences)
    gold = np.repeat([int(q == 1) for q in quality], [len(x) for x in sequences])
    single = fit(list(codes[:, None, :]), list(gold[:, None]))
    score = single.emit[codes].sum(axis=1) + single.begin[1] - single.begin[0]
    labels = np.split((score >= 0).astype(int), np.cumsum([len(x) for x in sequences])[:-1])
    enough = [(y * w).sum() >= content * w.sum() for y, w in zip(labels, words, strict=True)]
    return [y if good == (q == 1) else np.full_like(y, int(q == 1)) for y, good, q in zip(labels, enough, quality, strict=True)]


def viterbi(field: LineField, codes: np.ndarray) -> np.ndarray:
    """The best labels (1: content) of a document's lines; equal scores go to content."""
    content = field.emit[codes].sum(axis=1).tolist()
    (aa, ab), (ba, bb) = field.step.tolist()
    junk, good = field.begin.tolist()
    from_junk = []
    for j, e in enumerate(content):
        if j:
            to_good, to_junk = junk + ab > good + bb, junk + aa > good + ba
            junk, good = (junk + aa if to_junk else good + ba), (junk + ab if to_good else good + bb)
            from_junk.append((to_junk, to_good))
        good += e
    labels = [1 if good >= junk else 0]
    for to_junk, to_good in reversed(from_junk):
        labels.append(0 if (to_good if labels[-1] else to_junk) else 1)
    return np.array(labels[::-1] if content else [], np.int8)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> LineField:
    """Fit the field to at most ``sample`` rows of ``labels`` (doc_id, quality), those with the lowest hash of doc_id.

    Rows with a null doc_id or quality are left out. Without usable rows every line counts as content.
    """
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            stats = text_stats(encoded(batch.column("text")))
            owner, codes, words = [], [], []
            for d, (a, b) in enumerate(zip(stats.first_line.tolist(), stats.first_line[1:].tolist(), strict=False)):
                parts = -(-(b - a) // SEQUENCE)
                for part in np.unique(np.linspace(0, parts - 1, min(parts, SEQUENCES)).astype(int)).tolist():
                    start, end = a + part * SEQUENCE, min(b, a + (part + 1) * SEQUENCE)
                    owner.append(d)
                    codes.append(stats.codes[start:end].ravel())
                    words.append(stats.line_words[start:end].astype(np.int64))
            rows = batch.select(["doc_id", "quality"]).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(codes, pa.list_(pa.int16())), pa.array(words, pa.list_(pa.int64()))], names=["doc_id", "quality", "codes", "words"]
            )

    # the chosen rows are at most `sample`, whatever the corpus's size
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = rows.mapInArrow(lines, "doc_id long, quality int, codes array<short>, words array<long>").orderBy("doc_id", "quality", "codes", "words").collect()
    if not rows:
        return LineField(np.ones(int(OFFSETS[-1])), np.zeros((2, 2)), np.zeros(2))
    sequences = [np.array(row["codes"], np.int64).reshape(-1, len(OFFSETS) - 1) for row in rows]
    return fit(sequences, line_labels(sequences, [np.array(row["words"]) for row in rows], [row["quality"] for row in rows]))


def quality(docs: DataFrame, field: LineField, *, content: float = CONTENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept.

    Words are ``[^\\x20\\x09-\\x0D]+``, lines split at line feeds. A null text counts as empty: no words, base_failed.
    base_failed: under 50 words, or over half of the words in three-word windows that the text has twice or more.
    content_share is 0 without words. Whole texts are read; rows are judged alone, so repeated rows get equal results.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            s = text_stats(encoded(batch.column("text")))
            failed = (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)
            share = np.zeros(batch.num_rows)
            for d, (a, b) in enumerate(zip(s.first_line.tolist(), s.first_line[1:].tolist(), strict=False)):
                if b > a:
                    share[d] = (viterbi(field, s.codes[a:b]) * s.line_words[a:b]).sum() / s.line_words[a:b].sum()
            counts = [pa.array(x.astype(np.int64)) for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)]
            made = [*counts, pa.array(failed), pa.array(share), pa.array(~failed & (share >= content))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *RESULTS])

    docs = docs.drop(*RESULTS)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(judge, f"{fields}, {_RESULT_SCHEMA}")


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")
_RESULT_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
)
