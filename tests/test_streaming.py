"""The intake as a stream and the re-check per micro-batch."""

from datetime import datetime, timedelta
from decimal import Decimal

from proofrecon.plans.views import view
from proofrecon.streaming import intake
from tests.conftest import DATA
from tests.test_matching import CLAIM, ROW, claim, row


def test_intake(spark, tmp_path):
    messages = view(spark, DATA, "v_msgs")
    messages.write.parquet(str(tmp_path / "in"))
    stream = intake.replay(spark, str(tmp_path / "in"), messages.schema)
    q = intake.start_intake(stream, str(tmp_path / "records"), str(tmp_path / "alerts"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    n = [spark.read.parquet(str(tmp_path / d)).count() for d in ("records", "alerts")]
    assert sum(n) == messages.count() and min(n) > 0


def test_recheck(spark, tmp_path):
    t = datetime(2026, 1, 10, 12)
    rows = spark.createDataFrame([row("R", credit="7", dt=t), row("S", credit="8", dt=t + timedelta(days=2))], ROW)
    rows.write.parquet(str(tmp_path / "in"))
    claims = spark.createDataFrame([claim("a", "7"), claim("b", "9", ts=t + timedelta(days=1)), claim("c", "9", ts=t + timedelta(days=9))], CLAIM)
    q = intake.start_recheck(intake.replay(spark, str(tmp_path / "in"), rows.schema), claims, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = {r["claim_id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": "Likely Match", "b": "Not found", "c": "Can't verify yet"}
    assert Decimal("7") == rows.agg({"credit": "min"}).first()[0]


def test_recheck_of_a_split_statement(spark, tmp_path):
    """A statement in two parts: resolved claims stay, used rows stay used, the open claims meet all rows and their whole span."""
    t, ref = datetime(2026, 1, 10, 12), "123456789012"
    schema = ROW + ", parse_confidence double"
    parts = [
        [(*row("R", credit="7", dt=t), 0.9), (*row("S", credit="8", dt=t - timedelta(days=1)), 0.9)],
        [(*row("U", credit="9", dt=t + timedelta(days=2), ref=ref), 0.9), (*row("V", credit="5", dt=t + timedelta(days=3)), 0.9), (2, *row("W", credit="5", dt=t)[1:], 0.3)],
    ]
    claims = [claim("a", "7", ts=t - timedelta(minutes=40)), claim("b", "7", ts=t - timedelta(minutes=29)), claim("c", "9", ts=t + timedelta(days=2), ref=ref), claim("d", "6", ts=t + timedelta(days=1)), (2, *claim("e", "6", ts=t)[1:])]
    claims = spark.createDataFrame(claims, CLAIM)
    out, stream = str(tmp_path / "out"), None
    statuses = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = intake.replay(spark, str(tmp_path / "in"), spark.createDataFrame(part, schema).schema)
        q = intake.start_recheck(stream, claims, out, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
        last = intake.latest_verdicts(spark.read.parquet(out)).collect()
        statuses.append({r["claim_id"]: (r["status"], r["row_id"], r["reason"]) for r in last})
    assert statuses[0]["b"] == ("Likely Match", "R", "assigned") and statuses[0]["c"][0] == statuses[0]["d"][0] == "Can't verify yet"
    assert statuses[1] == {
        "a": ("Not found", None, "not_found"), "b": ("Likely Match", "R", "assigned"), "c": ("Verified", "U", "assigned"),
        "d": ("Not found", None, "not_found"), "e": ("Can't verify yet", None, "low_parse_confidence"),
    }
    again = [r["claim_id"] for r in spark.read.parquet(out).where("batch = 1").collect()]
    assert sorted(again) == ["a", "c", "d", "e"]
