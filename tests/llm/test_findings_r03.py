"""Tests of the findings of round 3 on the training-data operators."""

import re

from proofrecon.llm.secret_scan import Rule, find_secrets, searched


def test_short_runs_are_no_pieces(spark):
    """of hex only runs of 24 and more are matched, not the many shorter ones of any prose; other rules keep their pattern."""
    rules = (Rule("hex", r"[0-9a-f]+", 0, 24), Rule("number", r"[a-z][0-9]+", 0, 5))
    texts = ["faded " * 50_000 + "0123456789abcdef" * 2 + " bad \u20ac" + "c" * 24 + "x" + "d" * 23, "a1234 b123 c98765", "é" + "f" * 25]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["secrets"]] for r in find_secrets(docs, rules=rules).collect()}
    want = {n: sorted((m.start(), rule.kind, m.end()) for rule in rules for m in re.finditer(rule.pattern, t) if len(m[0]) >= rule.least) for n, t in enumerate(texts)}
    assert got == {n: [(kind, a, b) for a, kind, b in found] for n, found in want.items()} and all(got.values())
    assert not re.findall(searched(rules[0]), "faded " * 100)
