"""Test of the finding of round 3 on op2: the tool counted an executor twice while it started a process, as it does for each file."""

import base64
import hashlib
from collections import Counter
from pathlib import Path

import pytest

from proofrecon.llm.warc_archive import read_records, write_archive


@pytest.fixture
def spread(spark):
    """Many shuffle partitions, as on a large table."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "8k"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("copies", [0, 1, 60])
def test_few_files(spread, tmp_path, copies):
    """Payloads are stored by the tasks that read the pages, a file each, and not by all partitions of a shuffle; copies stay one payload."""
    htmls = [f"<p>{n}</p>" * 20 for n in range(400)] + ["same"] * copies + ["twice"] * (2 * bool(copies))
    pages = [(n, "u", h) for n, h in enumerate(htmls)]
    if copies:
        pages += [(pages[-2][0], "u", "twice"), (None, "u", "same"), (None, "u", "none"), (None, "v", "none")]
    write_archive(spread.createDataFrame(pages, "page_id long, url string, html string").coalesce(2), path := str(tmp_path / "a"))
    digests = {h: (len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for _, _, h in pages}
    least = {h: min((i for i, _, g in pages if g == h and i is not None), default=None) for h in digests}
    want = Counter((i, *digests[h], "response" if i == least[h] else "revisit", None if i == least[h] else least[h]) for i, _, h in pages)
    assert Counter(map(tuple, read_records(spread, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == want
    assert spread.read.parquet(f"{path}/payloads").count() == len(digests)
    if not copies:
        assert sum(1 for part in ("headers", "payloads") for _ in Path(path, part).glob("part-*")) <= 4
