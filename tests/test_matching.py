"""The matcher on small frames, and its assignment against brute force."""

import itertools
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest

from proofrecon.operators import matching

T = datetime(2026, 1, 10, 12)
CLAIM = "batch_id int, claim_id string, amount decimal(18,2), ts timestamp_ntz, reference string, payer_name string, payer_upi_id string, status_shown string, currency string, image_hash string, conf_amount double, conf_ts double, conf_ref double, conf_name double"
ROW = "batch_id int, row_id string, dt timestamp_ntz, narration string, debit decimal(18,2), credit decimal(18,2), ref string, name_hint string"
META = "batch_id int, coverage_start timestamp_ntz, coverage_end timestamp_ntz, parse_confidence double"


def claim(cid, amount="500", ts=T, ref=None, name=None, upi=None, status="success", currency="INR", image=None):
    return (1, cid, Decimal(amount) if amount else None, ts, ref, name, upi, status, currency, image, 0.9, 0.9, 0.9, 0.9)


def row(rid, credit="500", dt=T, ref=None, hint=None, narration="", debit=None):
    return (1, rid, dt, narration, Decimal(debit) if debit else None, Decimal(credit) if credit else None, ref, hint)


def run(spark, claims, rows, meta=None):
    meta = meta or [(1, T - timedelta(days=5), T + timedelta(days=5), 0.95)]
    out = matching.verify(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(rows, ROW), spark.createDataFrame(meta, META))
    return {r["claim_id"]: r for r in out.collect()}


def test_statuses(spark):
    refs = {k: f"12345678901{k}" for k in range(6)}
    rows = [
        row("R1", ref=refs[1]), row("R2", ref=refs[2]), row("R3", credit=None, debit="500", ref=refs[3]),
        row("R4", credit="77", dt=T + timedelta(minutes=10), hint="Asha Rao"), row("R5", credit="88"), row("R6", credit="88", dt=T + timedelta(minutes=1)),
    ]
    claims = [
        claim("a", ref=refs[1]), claim("b", "900", ref=refs[2]), claim("c", ref=refs[3]), claim("d", "77", name="Asha Rao"), claim("e", "88"), claim("f", "1"),
        claim("g", "1", ts=T + timedelta(days=9)), claim("h", None), claim("i", currency="USD"), claim("j", "77", status="failed"), claim("k", "1", ts=None),
    ]
    got = run(spark, claims, rows)
    assert {k: v["status"] for k, v in got.items()} == {
        "a": "Verified", "b": "Contradicted", "c": "Contradicted", "d": "Likely Match", "e": "Likely Match", "f": "Not found",
        "g": "Can't verify yet", "h": "Can't verify yet", "i": "Can't verify yet", "j": "Not found", "k": "Can't verify yet",
    }
    assert (got["d"]["tier"], got["e"]["tier"]) == (2, 3)
    assert got["b"]["reason"] == "amount" and got["c"]["reason"] == "direction" and got["b"]["confidence"] == 0.9
    assert got["g"]["follow_up_after"] == T + timedelta(days=10)


@pytest.mark.parametrize(("minutes", "found"), [(0, True), (29, True), (30, True), (31, False)])
def test_window(spark, minutes, found):
    got = run(spark, [claim("a")], [row("R", dt=T + timedelta(minutes=minutes))])
    assert (got["a"]["status"] == "Likely Match") == found


def test_duplicates_and_contests(spark):
    ref = "123456789012"
    got = run(spark, [claim("a", ref=ref), claim("b", ref=ref), claim("c", "9"), claim("d", "9")], [row("R", ref=ref), row("S", credit="9")])
    assert [got[k]["status"] for k in "abcd"] == ["Verified", "Duplicate", "Likely Match", "Not found"]
    assert got["d"]["reason"] == "lost_contest"
    near = [claim("x", "3", image="dhash256:" + "0" * 64), claim("y", "3", image="dhash256:" + "0" * 63 + "7")]
    assert run(spark, near, [row("R", credit="3")])["y"]["status"] == "Duplicate"


def test_coverage_edges(spark):
    end = T + timedelta(hours=1)
    meta = [(1, T - timedelta(days=1), end, 0.9)]
    got = run(spark, [claim("a", "1", ts=end - timedelta(minutes=30)), claim("b", "1", ts=end - timedelta(minutes=29))], [row("R", credit="2")], meta)
    assert [got[k]["status"] for k in "ab"] == ["Not found", "Can't verify yet"]


def test_empty(spark):
    assert run(spark, [], [row("R")]) == {}
    assert run(spark, [claim("a")], [], [])["a"]["reason"] == "no_rows"


def test_assignment_is_heaviest():
    rng = np.random.default_rng(0)
    for n, m in itertools.product((1, 2, 3, 4), (1, 2, 3, 4)):
        w = rng.integers(0, 50, (n, m)).astype(object) * 10**12
        got = matching._heaviest(w)
        mine = sum(w[i, j] for i, j in enumerate(got) if j >= 0)
        best = max(sum(w[i, j] for i, j in enumerate(p) if j < m) for p in itertools.permutations(range(max(n, m)), n)) if n <= max(n, m) else 0
        assert mine == best and len({j for j in got if j >= 0}) == sum(j >= 0 for j in got)


def test_order_does_not_matter(spark):
    rows = [row(f"R{k}", dt=T + timedelta(minutes=k)) for k in range(4)]
    claims = [claim(f"c{k}", ts=T + timedelta(minutes=3 * k)) for k in range(5)]
    a, b = run(spark, claims, rows), run(spark, claims[::-1], rows[::-1])
    assert {k: (v["status"], v["row_id"]) for k, v in a.items()} == {k: (v["status"], v["row_id"]) for k, v in b.items()}


def test_large_component(spark):
    """One fee at high density joins 2,101 claims and rows into one component: each still gets its row."""
    n, ref = 2100, "123456789012"
    at = [T + timedelta(minutes=20 * k) for k in range(n + 1)]
    rows = [row(f"R{k:05d}", dt=at[k], ref=ref if k == n else None) for k in range(n + 1)]
    claims = [claim(f"c{k:05d}", ts=at[k], ref=ref if k == n else None) for k in range(n + 1)]
    got = run(spark, claims, rows, [(1, T - timedelta(days=5), at[-1] + timedelta(days=5), 0.95)])
    assert {k: v["row_id"] for k, v in got.items()} == {f"c{k:05d}": f"R{k:05d}" for k in range(n + 1)}
    assert got[f"c{n:05d}"]["status"] == "Verified" and {v["status"] for k, v in got.items() if k != f"c{n:05d}"} == {"Likely Match"}


def test_conflicting_names(spark):
    """Two payers with one reference: none is verified, unless the statement's name hint tells which one it is."""
    one, two, three = "123456789012", "223456789012", "323456789012"
    claims = [
        claim("a", ref=one, name="Asha Rao"), claim("b", ref=one, name="Vikram Singh"), claim("c", ref=one, name="Asha Rao"),
        claim("d", ref=two, name="Asha Rao"), claim("e", ref=two, name="Asha Rao"),
        claim("f", ref=three, name="Asha Rao", upi="asha@bank"), claim("g", ref=three, name="Vikram Singh", upi="asha@bank"),
    ]
    got = run(spark, claims, [row("R", ref=one), row("S", ref=two), row("U", ref=three, hint="Asha Rao", narration="UPI asha@bank")])
    assert [got[k]["status"] for k in "abcdefg"] == ["Duplicate"] * 3 + ["Verified", "Duplicate"] * 2
    assert {(got[k]["confidence"], got[k]["row_id"], got[k]["reason"], got[k]["tier"]) for k in "abc"} == {(0.65, "R", "conflicting_names", None)}
    assert got["e"]["reason"] == got["g"]["reason"] == "duplicate"
