"""Whole verdicts against the plain verifier: on the registered input, and on random batches full of contests and clashes."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from proofrecon.operators import matching
from proofrecon.plans.catalogue import QUERIES
from proofrecon.plans.views import view
from tests.conftest import DATA
from tests.plain_verifier import grouped, matched, verified
from tests.test_matching import CLAIM, META, ROW


def by_batch(frame):
    out = defaultdict(list)
    for r in frame.collect():
        out[r["batch_id"]].append(r.asDict())
    return out


def told(r):
    return (r["status"], r["tier"], r["row_id"], round(float(r["confidence"]), 3), r["reason"], r["follow_up_after"])


def expected(claims, rows, meta):
    out = {}
    for b, own in claims.items():
        for x, (status, tier, row, confidence, reason, later) in verified(own, rows[b], meta[b][0]).items():
            out[b, x] = (status, tier, row, round(confidence, 3), reason, later)
    return out


def close(got, want):
    assert got.keys() == want.keys()
    wrong = {k: (got[k], want[k]) for k in got if got[k][:3] + got[k][4:] != want[k][:3] + want[k][4:] or abs(got[k][3] - want[k][3]) > 0.0011}
    assert not wrong, dict(list(wrong.items())[:5])


@pytest.mark.parametrize("name", ["verify_claims"])
def test_registered_input(spark, name):
    rows = by_batch(view(spark, DATA, "v_stmt"))
    for own in rows.values():
        for r in own:
            r["name_hint"] = r["name"]
    want = expected(by_batch(view(spark, DATA, "v_claims")), rows, by_batch(view(spark, DATA, "v_meta")))
    got = {(r["batch_id"], r["claim_id"]): told(r) for r in QUERIES[name](spark, DATA).collect()}
    close(got, want)


def test_random_batches(spark):
    """Every status and most reasons: few amounts, shared references and names, debits, days without a time, odd claims."""
    rng, t = random.Random(11), datetime(2026, 1, 10, 12)
    names = ["Asha Rao", "Ravi Iyer", "A Rao", "Asha", "Meena Das", None]
    refs = [f"12345678{k:04d}" for k in range(12)]
    claims, rows, meta = [], [], []
    for b in range(12):
        for k in range(14):
            amount, moment = Decimal(rng.randint(1, 3)), t + timedelta(minutes=rng.randint(0, 240))
            moment = datetime(2026, 1, 10) if rng.random() < 0.15 else moment
            ref, inward = rng.choice([*refs, None, None, None]), rng.random() < 0.8
            text = rng.choice(["UPI/x", "UPI/asha rao/asha@ybl", f"UPI/{rng.choice(refs)}/y"])
            rows.append((b, f"R{k:02d}", moment, text, None if inward else amount, amount if inward else None, ref, rng.choice(names)))
        for k in range(18):
            image = rng.choice([None, None, "sha256:a", "sha256:b", "dhash256:" + "0" * 64, "dhash256:" + "0" * 63 + "7", "dhash256:" + "f" * 64])
            ts = rng.choice([None, *[t + timedelta(minutes=rng.randint(-60, 300)) for _ in range(9)], t + timedelta(days=5)])
            claims.append((b, f"C{k:02d}", rng.choice([Decimal(rng.randint(1, 3))] * 9 + [None]), ts, rng.choice([*refs, *[None] * 9]), rng.choice(names), rng.choice([None, "asha@ybl", "as**@ybl"]),
                           rng.choice(["success", "success", "pending", "failed"]), rng.choice(["INR"] * 9 + ["USD"]), image, rng.choice([0.95, 0.4, None]), 0.9, rng.choice([0.3, 0.9]), 0.8))
        meta.append((b, t - timedelta(hours=1), t + timedelta(hours=4), 0.95 if b % 5 else 0.3))
    c, r, m = spark.createDataFrame(claims, CLAIM), spark.createDataFrame(rows, ROW), spark.createDataFrame(meta, META)
    want = expected(by_batch(c), by_batch(r), by_batch(m))
    got = {(x["batch_id"], x["claim_id"]): told(x) for x in matching.verify(c, r, m).collect()}
    close(got, want)
    assert {v[0] for v in got.values()} == {"Verified", "Likely Match", "Contradicted", "Duplicate", "Not found", "Can't verify yet"}
    assert {v[4] for v in got.values()} >= {"assigned", "direction", "conflicting_names", "duplicate", "currency", "no_amount", "not_found"}


def test_assignment_of_random_edges(spark):
    rng = random.Random(2)
    edges = {}
    for b in range(6):
        for _ in range(14):
            edges[b, f"c{rng.randrange(8)}", f"r{rng.randrange(8)}"] = (rng.randint(1, 3), rng.randint(1, 30) / 2)
    frame = spark.createDataFrame([(*k, t, float(p)) for k, (t, p) in edges.items()], "batch_id int, claim_id string, row_id string, tier int, points double").repartition(4)
    got = Counter(tuple(r) for r in matching.assign(frame).collect())
    want = Counter()
    for b in range(6):
        own = {(c, r): v for (x, c, r), v in edges.items() if x == b}
        where = grouped([(("c", c), ("r", r)) for c, r in own])
        for part in set(where.values()):
            want.update((b, c, r) for c, r in matched({k: v for k, v in own.items() if where["c", k[0]] == part}))
    assert got == want
