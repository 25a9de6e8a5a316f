"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 3-grams of a language from the most frequent on. A text is ranked alike, and the
out-of-place distance sums, over its grams, how far each lies from its place in a profile; the nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofrecon.llm.common import chunks, cut

#: Length of a profile, and of a text's own ranking.
RANKS = 300
#: Documented bound of the fit: about so many labelled documents of each language, those with the lowest hash of doc_id.
PER_LANGUAGE = 4000


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Gram codes of all texts, lower-cased, words padded with one gap each side, and where each text's codes begin.

    A symbol is a code point + 2, a gap 1; a code has 21 bits for each symbol, so grams of all lengths differ. Grams
    that are a gap or have one in the middle are left out, and a letter between two gaps is no gram of three.
    """
    low = [(t or "").lower() for t in texts]
    size = np.cumsum([0, *(len(t) + 1 for t in low)])
    code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letters()[code]
    # a gap stays only after a letter; each text then begins with the gap that ended the text before
    keep = letter | np.append(False, letter[:-1])
    keep[0] = True
    symbol = np.where(letter, code + 2, 1)
    text = np.repeat(np.arange(len(low)), np.diff(size))
    symbol, text = np.append(1, symbol[keep]), np.append(0, text[keep])
    a, b, c = symbol[:-2], symbol[1:-1], symbol[2:]
    one = symbol > 1
    two = (symbol[:-1] > 1) | (symbol[1:] > 1)
    three = (b > 1) & ((a > 1) | (c > 1))
    two_text = np.where(symbol[:-1] > 1, text[:-1], text[1:])
    codes = np.concatenate([symbol[one], ((symbol[:-1] << 21) | symbol[1:])[two], ((a << 42) | (b << 21) | c)[three]])
    owner = np.concatenate([text[one], two_text[two], text[1:-1][three]])
    order = np.argsort(owner, kind="stable")
    return codes[order], np.searchsorted(owner[order], np.arange(len(low) + 1))


def ranking(codes: np.ndarray, most: int = RANKS) -> np.ndarray:
    """The most frequent codes, equal counts by code."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(codes)))
    if len(first) > most:
        least = np.partition(count, len(count) - most)[len(count) - most]
        some = count >= least
        first, count = first[some], count[some]
    return codes[first[np.argsort(-count, kind="stable")[:most]]]


def learn(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Profiles of the languages of ``docs`` (doc_id, text, lang): gram codes from the most frequent on.

    Rows without doc_id, text or language are left out. Of a language with more than ``per_language`` rows, the share
    that keeps about so many is used, by hash of doc_id.
    """
    rows = docs.where("doc_id is not null and text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    rates = [(lang, min(1_000_000, per_language * 1_000_000 // n)) for lang, n in counts.items()]
    rates = docs.sparkSession.createDataFrame(rates, "lang string, rate long")  # one row per language
    chosen = rows.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("rate")).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            codes, at = grams(batch.column("text").to_pylist())
            langs = np.array(batch.column("lang").to_pylist(), object)
            owner = np.repeat(np.arange(len(langs)), np.diff(at))
            for lang in sorted(set(langs)):
                found, n = np.unique(codes[(langs == lang)[owner]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)], names=["lang", "gram", "n"])

    totals = cut(chosen.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    best = [totals.where(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(RANKS) for lang in sorted(counts)]
    profiles: dict[str, list[tuple]] = {}
    for r in reduce(DataFrame.unionAll, best).collect():  # RANKS rows per language
        profiles.setdefault(r["lang"], []).append((-r["n"], r["gram"]))
    return {lang: np.array([gram for _, gram in sorted(rows)], np.int64) for lang, rows in profiles.items()}


class Nearest:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray]) -> None:
        self.langs = sorted(profiles)
        self.known = np.unique(np.concatenate([*profiles.values(), np.zeros(1, np.int64)]))
        self.rank = np.full((len(self.known) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.known, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """For each language the sum over the text's grams; a gram that a profile lacks is RANKS out of place."""
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        rank = self.rank[np.where(self.known[at] == own, at, len(self.known))]
        return np.where(rank < 0, RANKS, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` (text and more) with lang_pred and score; input columns of these names are replaced.

    lang_pred is the nearest profile's language, of equal ones the first by name; und if the text is null or has no
    letter, or nothing was learned. score is 1 less the distance's share of the greatest possible one; 0 for und. Whole
    texts are ranked, each alone.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(profiles) if profiles else None
        for batch in chunks(batches, "text"):
            codes, at = grams(batch.column("text").to_pylist())
            langs, scores = [], []
            for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
                if a == b or nearest is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                own = ranking(codes[a:b])
                distance = nearest.distances(own)
                k = int(distance.argmin())
                langs.append(nearest.langs[k])
                scores.append(1 - float(distance[k]) / (RANKS * len(own)))
            made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "lang_pred", "score"])

    docs = docs.drop("lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(judged, f"{fields}, lang_pred string, score double")
