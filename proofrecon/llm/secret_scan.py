"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regex gives a Boolean trigram query. The index has a posting (trigram, doc_id) for each trigram that some
query needs; intersected postings give each rule's candidates, and only those are verified with the regex. Rules
without a mandatory trigram scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofrecon.functions.text import let
from proofrecon.llm.common import cut
from proofrecon.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base kinds, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What is searched for besides.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the vocabulary's trigrams in the lower-cased texts, stored in trigram order.

    The order is by trigram and doc_id, so that a trigram in a third of all texts still spreads over many files.
    """
    low = docs.select("doc_id", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in vocabulary)))
    postings = cut(low.select("doc_id", F.explode(found).alias("trigram")))
    return cut(postings.repartitionByRange("trigram", "doc_id").sortWithinPartitions("trigram", "doc_id"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, rules): for each document the rules of which some clause has all its trigrams posted."""
    wanted = [(kind, f"{kind}{n}", t) for kind, clauses in queries.items() for n, clause in enumerate(clauses) for t in sorted(clause)]
    terms = index.sparkSession.createDataFrame(wanted, "rule string, clause string, trigram string")
    needs = {f"{kind}{n}": len(clause) for kind, clauses in queries.items() for n, clause in enumerate(clauses)}
    need = reduce(lambda rest, x: F.when(F.col("clause") == x[0], x[1]).otherwise(rest), needs.items(), F.lit(0))
    # terms holds the rules' trigrams, so its size is the rule set's, not the corpus's
    hits = index.distinct().join(F.broadcast(terms), "trigram").groupBy("doc_id", "rule", "clause").agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == need).groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def prefix_sums(numbers: Column) -> Column:
    """The sum of each number and all before it, by doubling: as many passes as the array's size has bits."""
    bits = F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int")

    def doubled(sums: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), bits), numbers, doubled)


def searched(rule: Rule) -> str:
    """The pattern to search with: of a lone character class only runs that are long enough, as text is full of shorter ones."""
    if rule.group == 0 and rule.least and re.fullmatch(r"\[[^\[\]\\]+\]\+", rule.pattern):
        return rule.pattern[:-1] + f"{{{rule.least},}}"
    return rule.pattern


def matches(text: Column, rule: Rule) -> Column:
    """All matches of a rule in a text: array of (start, end) in code points, end exclusive."""
    pattern = searched(rule)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else hits
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), groups.alias("group"))

    def sized(p: Column) -> Column:
        return F.struct((F.char_length(p["gap"]) + F.coalesce(F.char_length(p["hit"]), F.lit(0))).alias("all"), F.char_length(p["hit"]).alias("hit"), F.char_length(p["group"]).alias("group"))

    def placed(p: Column, end: Column) -> Column:
        return F.when(p["group"] >= rule.least, F.struct((end - p["hit"]).alias("start"), end.alias("end")))

    spans = let(F.transform(pieces, sized), lambda sizes: F.zip_with(sizes, prefix_sums(F.transform(sizes, lambda p: p["all"])), placed))
    return F.array_compact(spans)


def _tagged(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (doc_id, text and more) with ``secrets``: array of (start, rank, kind, end), by start and then kind as listed.

    A null or empty text has no secrets. Rows that repeat a doc_id (or have none) share candidates but are verified each
    on their own text. An input column named secrets is replaced.
    """
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: clauses for kind, clauses in queries.items() if clauses is not None}
    docs = docs.drop("secrets", "_id", "_rules")
    if indexed:
        vocabulary = sorted({t for clauses in indexed.values() for clause in clauses for t in clause})
        found = candidates(trigram_index(docs, vocabulary), indexed)
        found = cut(found.select(F.col("doc_id").alias("_id"), F.col("rules").alias("_rules")))
        docs = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]), "left")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    for rank, rule in enumerate(rules):
        if rule.kind in indexed:
            wanted = F.coalesce(F.array_contains("_rules", rule.kind), F.lit(False))
        else:
            wanted = text.rlike(f"(?:{searched(rule)})")
        spans = F.when(wanted, matches(text, rule)).otherwise(empty)
        parts.append(_tagged(spans, rank, rule.kind))
    return docs.withColumn("secrets", F.array_sort(F.concat(*parts))).drop("_id", "_rules")


def listed(secrets: Column) -> Column:
    """kind:start:end of each secret, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(secrets: Column, *kinds: str) -> Column:
    return F.filter(secrets, lambda s: s["kind"].isin(*kinds))


def redacted(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping secrets replaced by ``mark``."""

    def step(state: Column, s: Column) -> Column:
        more = F.when(
            s["start"] >= state["at"], F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        ).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), more.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    folded = F.aggregate(secrets, start, step, lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.char_length(text))))
    return F.when(F.size(secrets) > 0, folded).otherwise(text)
