"""The pipeline's stages against brute force on the smallest documents table."""

import re
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from proofrecon.llm import line_crf
from proofrecon.llm.common import cut, table
from proofrecon.llm.secret_scan import RULES
from tests.conftest import DATA
from tests.llm.test_operators import ids_of, shingle_set


def test_stages(spark):
    docs = cut(table(spark, DATA, "documents"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, DATA))
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = (before.collect(), docs.collect())

    was, now = kept["quality_rules"]
    field = line_crf.train(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    fine = {r["doc_id"] for r in line_crf.quality(table(spark, DATA, "documents").select("doc_id", "text"), field).where("kept").collect()}
    assert {r["doc_id"] for r in now} == fine
    good = {r["doc_id"] for r in table(spark, DATA, "labels").where("quality = 1").collect()}
    long_good = {r["doc_id"] for r in was if r["doc_id"] in good and len((r["text"] or "").split()) >= 50}
    assert len(long_good & fine) >= 0.95 * len(long_good)

    was, now = kept["near_dedup"]
    sets = {r["doc_id"]: shingle_set(r["text"], 5) for r in was}
    comp = {i: i for i in sets}
    for _ in range(10):
        for a, s in sets.items():
            for b, t in sets.items():
                if a < b and s and 100 * len(s & t) >= 80 * len(s | t):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r["doc_id"] for r in now} == {i for i, c in comp.items() if i == c}

    was, now = kept["secret_scan"]
    text = {r["doc_id"]: r for r in was}
    assert {r["doc_id"] for r in now} == set(text)
    for r in now:
        old = text[r["doc_id"]]["text"]
        found = [m for rule in RULES for m in re.finditer(rule.pattern, old, re.A) if len(m[rule.group]) >= rule.least]
        assert (r["text"] == old) == (not found)
        assert r["n_chars"] == (len(r["text"]) if found else text[r["doc_id"]]["n_chars"])
        assert all(m[0] not in r["text"] for m in found)

    was, now = kept["source_mixing"]
    assert max(Counter(r["doc_id"] for r in now).values()) <= 3
    assert set(now) <= set(was)

    was, now = kept["packing"]
    ids = sum(len(ids_of("word_bpe_49k.json", r["text"], 1)) for r in was)
    assert sum(r["length"] for r in now) == ids


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "source_mixing", "packing"]
