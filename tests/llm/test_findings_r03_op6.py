"""Tests of the finding of round 3 on op6: one verdict, no size that reads like one, and no task for one common passage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofrecon.llm import repeated_passages
from proofrecon.llm.queries import QUERIES
from proofrecon.llm.repeated_passages import remove_repeats
from tests.conftest import DATA

HOT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.files.maxPartitionBytes": "64k",
}


@pytest.fixture
def hot(spark):
    """Skewed joins are split from 16 kB on."""
    before = {k: spark.conf.get(k) for k in HOT}
    for k, v in HOT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_one_verdict(spark):
    """what was removed is told by n_removed and has_repeats; no further column has a size of what is kept."""
    got = QUERIES["op6_radix_dedup"](spark, DATA)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_repeats"]
    assert got.where("has_repeats <> (n_removed > 0)").isEmpty() and got.where("has_repeats").count() > 0


def test_planted_passages(spark):
    """of passages of over 50 words in two documents those of 400 bytes and more are removed, all of them; no shorter one is, and no clean document is touched."""
    rng = np.random.default_rng(5)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(4, 10)))) for _ in range(n))
    passages = [words(n) for n in (51, 55, 60, 80, 120)] + [" ".join(["ab" + c for c in words(51).split()])[:390], "é" * 199 + "x", "é" * 200]
    docs = [(10 * n + k, f"{words(60)}\n{p}\n{words(60)}") for n, p in enumerate(passages) for k in range(2)] + [(1000 + n, words(150)) for n in range(20)]
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for n, p in enumerate(passages):  # the line ends belong to the passage, too
        size = len(f"\n{p}\n".encode())
        assert {got[10 * n], got[10 * n + 1]} == {size if size >= 400 else 0}
    assert not any(got[1000 + n] for n in range(20))


def test_common_passage_is_split(hot, monkeypatch):
    """the rows of one passage that very many documents hold are joined by several tasks."""
    tasks, plain = [], repeated_passages.cut

    def noted(df, *path):
        written = plain(df, *path)
        if {"mixed", "doc_id"} <= {*df.columns}:  # a file per task
            tasks.append([r["count"] for r in written.groupBy(F.input_file_name()).count().collect()])
        return written

    monkeypatch.setattr(repeated_passages, "cut", noted)
    rng = np.random.default_rng(6)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n))
    common = words(70)
    docs = [(n, f"{words(5)} {common} {words(5)}") for n in range(4000)]
    got = remove_repeats(hot.createDataFrame(docs, "doc_id long, text string").repartition(16), length=400)
    assert got.where(f"n_removed < {len(common)}").isEmpty() and got.count() == 4000
    assert len(tasks) == 2 and all(max(t) < 0.6 * sum(t) for t in tasks)
