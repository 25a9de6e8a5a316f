"""Archives, messages, words, evidence, components and the inbox's bounded state on small inputs."""

import io
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from proofrecon.operators import evidence, geometry, matching, messages
from proofrecon.operators.components import components
from proofrecon.sources.archives import archive_entries, entries, read_archives, senders
from proofrecon.streaming import inbox, intake
from tests.test_matching import CLAIM, claim

PNG = b"\x89PNG\r\n\x1a\n"


def archive(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_archive_refusals(monkeypatch):
    chat = "[10/10/26, 4:12:30 PM] Asha Rao: <attached: a.png>\n10/10/26, 4:13 pm - Ravi: b.jpg (file attached)\nno picture here\n"
    data = archive(("a.png", PNG + b"1"), ("b.jpg", b"\xff\xd8\xff2"), ("../c.png", PNG), ("/d.png", PNG), ("e.png", b"GIF89a"), ("voice.opus", b"x"), ("x/_chat.txt", chat), ("f\\g.png", PNG + b"3"))
    got = [(e[0], e[1], e[2], e[3], e[4], e[5]) for e in entries(data, 2)]
    assert got == [
        ("c.png", "other", 0, None, None, 8), ("d.png", "other", 0, None, None, 8), ("a.png", "image", 1, "Asha Rao", "10/10/26, 4:12:30 PM", 9), ("b.jpg", "image", 2, "Ravi", "10/10/26, 4:13 pm", 4),
        ("e.png", "other", 0, None, None, 6), ("g.png", "over", 0, None, None, 9), ("voice.opus", "other", 0, None, None, 1), ("_chat.txt", "other", 0, None, None, len(chat)),
    ]
    assert [e[1] for e in entries(b"no archive")] == ["not_an_archive"]
    monkeypatch.setattr("proofrecon.sources.archives.MOST_FILES", 3)
    assert [e[1] for e in entries(data)] == ["too_many_files"]
    monkeypatch.setattr("proofrecon.sources.archives.MOST_FILES", 99)
    monkeypatch.setattr("proofrecon.sources.archives.PICTURES", 10)
    assert [e[1] for e in entries(data) if e[1] != "other"] == ["image", "over_bytes"]
    monkeypatch.setattr("proofrecon.sources.archives.PICTURE", 8)
    assert [e[0] for e in entries(data) if e[1] == "too_big"][:1] == ["a.png"]
    monkeypatch.setattr("proofrecon.sources.archives.LARGEST", 8)
    assert [e[1] for e in entries(data)] == ["archive_too_large"]


def test_archives_of_a_folder(spark, tmp_path):
    (tmp_path / "one.zip").write_bytes(archive(("a.png", PNG), ("_chat.txt", "[1/1/26, 1:00] Zoë: <attached: a.png>")))
    (tmp_path / "two.zip").write_bytes(b"broken")
    got = sorted((r["archive"][-7:], r["kind"], r["entry"], r["sender"]) for r in read_archives(spark, str(tmp_path)).collect())
    assert got == [("one.zip", "image", "a.png", "Zoë"), ("one.zip", "other", "_chat.txt", None), ("two.zip", "not_an_archive", None, None)]
    assert archive_entries(spark.createDataFrame([], "archive string, content binary")).count() == 0
    assert senders("") == {}


def test_messages(spark):
    rows = [("x {\"id\": \" m1 \", \"from\": [{\"email\": \"A@B.c\"}], \"labels\": [\"B\", null, \"a\"]} y",), ("{\"id\": {}}",), ("no",), (None,), ("} {",), ("{\"id\": 7, \"from\": \"N <n@x>\", \"ai\": 3, \"attachments\": {}}",)]
    got = [r["m"].asDict(recursive=True) for r in spark.createDataFrame(rows, "raw string").select(messages.message(F.col("raw")).alias("m")).collect()]
    assert [(m["id"], m["sender"], m["labels"], m["broken"]) for m in got] == [("m1", "a@b.c", ["a", "b"], False), *[(None, None, [], True)] * 4, ("7", "n@x", [], False)]
    assert all(m["injection"] is None and m["attachments"] == [] and m["analysis"] == "unavailable" for m in got)


def test_geometry_without_table(spark):
    words = spark.createDataFrame([("f", 0, "hello", 1.0, 9.0, 5.0), ("f", 0, " ", 1.0, 9.0, 5.0), ("f", 1, "Date", 1.0, 9.0, 5.0)], "file string, page int, text string, x0 double, x1 double, top double")
    assert geometry.table_cells(words).count() == 0
    assert geometry.table_cells(words.limit(0)).count() == 0


def test_export_is_written(spark, tmp_path):
    row = spark.createDataFrame([("c1", "=cmd", "1.00", None, "Verified", 0.955, "S1", ["a", 'b "q"'], None, "Hi,\nthere")], "claim_id string, payer string, amount string, reference string, status string, confidence double, row_id string, reasons array<string>, follow_up_after timestamp_ntz, reply string")
    table = evidence.export_table(row.withColumn("diffs", F.array().cast("array<struct<field:string,claimed:string,shown:string>>")))
    evidence.write_export(table.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text == "﻿" + ",".join(evidence.EXPORT) + "\nc1,'=cmd,1.00,\"\",Verified,96,S1,\"a | b \"\"q\"\"\",\"\",\"\",\"Hi,\nthere\"\n"


def test_worded_replies(spark):
    frame = spark.createDataFrame([("Likely Match", 3, "S7", 0.7, "assigned", None, []), ("Can't verify yet", None, None, 0.0, "no_amount", None, []), ("Can't verify yet", None, None, 0.0, "after_end", datetime(2026, 1, 2, 3, 4), [])],
                                  "status string, tier int, row_id string, confidence double, reason string, follow_up_after timestamp_ntz, diffs array<struct<field:string,claimed:string,shown:string>>")
    assert [r[0] for r in frame.select(evidence.worded(evidence.reply_parts())).collect()] == [
        "It is line S7 of the statement. The evidence is fair. Only amount and time fit. Please send its reference number.", "Please tell the amount.", "A statement that reaches 02 Jan 2026 03:04 is needed.",
    ]


def roots(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(4)
    pairs = {"chain": [(k, k + 1) for k in range(3000)], "star": [(0, k) for k in range(1, 500)] + [(9, 9)], "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]}[kind]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: v for k, v in roots([p for p in pairs if p[0] != p[1]]).items()}


def test_links_join_what_all_pairs_join(spark):
    """Chains of links against all pairs, in groups and in the kinds that each claim has."""
    rng, t = random.Random(5), datetime(2026, 1, 1)
    base = [f"{k:x}" * 8 for k in range(8)]
    hashes = ["dhash256:" + "".join(base), "dhash256:" + "".join(["00000001", *base[1:]]), "dhash256:" + "".join([*base[:7], "77777776"]), "dhash256:" + "f" * 64, "sha256:a", None]
    claims = [claim(f"c{k:03d}", str(rng.randint(1, 3)), ts=t + timedelta(seconds=rng.randint(0, 900)), ref=rng.choice([None, None, "123456789012", "123456789013"]), image=rng.choice(hashes)) for k in range(70)]
    prepared = matching.prepared_claims(spark.createDataFrame(claims, CLAIM))
    links = [(r["a"], r["b"], r["kind"]) for r in matching.claim_links(prepared).collect()]
    want = set()
    for k, a in enumerate(claims):
        for b in claims[k + 1 :]:
            ref, near_time = a[4] and a[4] == b[4], a[2] == b[2] and abs((a[3] - b[3]).total_seconds()) <= 60
            if ref:
                want.add((a[1], b[1], "reference"))
            if a[9] and b[9] and a[9] == b[9] and a[9][0] == "s":
                want.add((a[1], b[1], "file"))
            if a[9] and b[9] and a[9][0] == b[9][0] == "d" and (ref or near_time):
                bits = bin(int(a[9][9:], 16) ^ int(b[9][9:], 16)).count("1")
                if bits <= 6:
                    want.add((a[1], b[1], "image_near" if bits else "image_identical"))
    assert set(links) <= want and len(set(links)) == len(links)
    for kind in {k for *_, k in want}:
        mine, all_ = [(a, b) for a, b, k in links if k == kind], [(a, b) for a, b, k in want if k == kind]
        assert roots(mine) == roots(all_), kind
    groups = {r["claim_id"]: r["group_id"] for r in matching.duplicate_groups(spark.createDataFrame([(1, a, b, k) for a, b, k in links], "batch_id int, a string, b string, kind string")).collect()}
    assert groups == roots([(a, b) for a, b, _ in want])


def test_inbox_remembers(spark, tmp_path):
    """Each message once, across a restart; what is older than the kept ones is forgotten."""
    key, provider = inbox.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        t = datetime(2026, 1, 1)
        row = lambda box, n: (box, f"m{n}", t + timedelta(minutes=n), "accepted", "none")
        schema = "inbox string, id string, created_at timestamp, status string, severity string"
        seen = []
        for part in ([row("a", 1), row("a", 2), row("a", 3), row("a", 4), row("b", 1)], [row("a", 3), row("a", 5), row("b", 1), row("b", 2)], [row("a", 1), row("a", 4), row("a", 5)]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q = inbox.start_inbox(intake.replay(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp"), 3)
            q.processAllAvailable()
            q.stop()
            rows = spark.read.parquet(str(tmp_path / "out"))
            seen.append(rows.count())
        assert seen == [5, 7, 8]
        assert [r["id"] for r in inbox.newest(rows.where("inbox = 'a'"), 2).collect()] == ["m5", "m4"]
    finally:
        spark.conf.set(key, before)
