"""Fields of screenshots, claims made from them, and hints of modified images."""

from decimal import Decimal

from pyspark.sql import functions as F

from proofrecon.functions import screens
from proofrecon.operators import claims, followup
from tests.test_cells import column


def read(spark, values, make):
    return column(spark, values, lambda x: make(x))


def test_reference(spark):
    cases = {
        "123456789012": "123456789012", "UPI Ref No: 1234 5678 9012": "123456789012", "1234-5678-9012": "123456789012", "１２３４５６７８９０１２": "123456789012",
        "123456789012 and 1234 5678 9012": "123456789012", "123456789012 / 123456789013": None, "12345678901": None, "1234567890123": None, "12345678901O": None,
        "777777777777": None, "": None, None: None,
    }
    got = read(spark, list(cases), screens.reference)
    assert [g["value"] for g in got] == list(cases.values())
    assert [g["penalty"] for g in got[:5]] == [1.0, 0.95, 0.95, 1.0, 1.0]
    assert [len(g["notes"]) for g in got] == [0, 1, 1, 0, 0, 1, 1, 1, 1, 1, 0, 0]


def test_amount_and_currency(spark):
    cases = {
        "₹1,23,456.50": ("123456.50", 1.0, "INR"), "Rs.500": ("500.00", 1.0, "INR"), "Paid ₹500 to Asha": ("500.00", 0.9, "INR"), "500/-": ("500.00", 0.9, "INR"), "1,234,567": ("1234567.00", 1.0, None),
        "500 rs": ("500.00", 0.9, "INR"), "₹500 or Rs 500": ("500.00", 0.9, "INR"), "₹500 or ₹600": None, "Rs 500 Rs 600": None, "Paid 300 to 9876543210": None, "₹0": None, "-5": None, "₹5.123": None, "₹12,3": None, "abc": None, None: None,
    }
    got = read(spark, list(cases), screens.amount)
    want = [c and (Decimal(c[0]), *c[1:]) for c in cases.values()]
    assert [(g["value"], g["penalty"], g["currency"]) if g["value"] is not None else None for g in got] == want
    assert [len(g["notes"]) for g in got] == [0] * 7 + [1] * 8 + [0]
    marked = read(spark, ["₹", "Rs.", "usd", "Dollars", None], lambda x: screens.currency(x, F.lit("INR")))
    assert [m["value"] for m in marked] == ["INR", "INR", None, "INR", "INR"]
    assert read(spark, ["eur", None], lambda x: screens.currency(x, F.lit(None).cast("string"))["value"]) == ["EUR", None]


def test_timestamp(spark):
    cases = {
        "03/04/2026 10:05": "2026-04-03T10:05:00", "3 Apr 2026, 1:05 p.m.": "2026-04-03T13:05:00", "10:05 AM on 3rd Sept 2026": "2026-09-03T10:05:00", "2026-04-03T10:05:07.123+05:30": "2026-04-03T10:05:07",
        "April 3, 2026 at 12:00 am": "2026-04-03T00:00:00", "3-4-26 23:59": "2026-04-03T23:59:00",
        "31/02/2026 10:05": None, "13:05 PM 3 Apr 2026": None, "3 Apr 2026 24:00": None, "10:05 3 Apr 2026 11:05": None, "3 Apr 1999 10:05": None, "20260403 10:05": None, "soon": None, None: None,
    }
    got = read(spark, list(cases), screens.timestamp)
    assert [g["iso"] for g in got] == list(cases.values())
    assert all(g["precision"] is None for g, w in zip(got, cases.values(), strict=True) if w is None)
    half = read(spark, ["3 Apr 2026", "10:05 IST"], screens.timestamp)
    assert [(h["iso"], h["date"], h["time"], h["precision"], len(h["notes"])) for h in half] == [(None, "2026-04-03", None, "date", 1), (None, None, "10:05:00", "time", 2)]


def test_identity(spark):
    assert read(spark, [" ASHA  rao", "ASHA RAO", "McDonald", "123", None], lambda x: screens.name(x)["value"]) == ["ASHA rao", "Asha Rao", "McDonald", None, None]
    got = read(spark, ["User1 @Bank", "us**1@bank", "a@bank", "x y", "a.b@c@d", None], screens.address)
    assert [(g["value"], g["masked"]) for g in got] == [("user1@bank", False), ("us**1@bank", True), *[(None, False)] * 4]
    texts = ["Payment unsuccessful", "Processing", "Paid", "Transaction cancelled", "Hello", None]
    assert read(spark, texts, lambda x: screens.status(x)["value"]) == ["failed", "pending", "success", "failed", None, None]
    assert read(spark, ["tez", "teza", "My GPay", "google pay app", None], lambda x: screens.app(x)["value"]) == ["Google Pay", None, None, "Google Pay", None]


def test_assemble(spark):
    schema = "claim_id string, source_file string, image_hash string, fields map<string, struct<value: string, confidence: string>>, notes array<string>, conf string"
    many = [f"note {k} " + "x" * 200 for k in range(14)]
    rows = [
        ("a", "C:\\x\\shot.png", None, {"reference": ("1234 5678 9012", "0.8"), "amount": ("₹50", None), "payer_upi_id": ("ab**@bank", "0.9"), "timestamp": ("3 Apr 2026", "nan")}, ["seen", "seen"], "clash"),
        ("b", None, None, None, None, None),
        ("c", "", None, {"amount": ("", "1")}, many, None),
    ]
    a, b, c = claims.assemble(spark.createDataFrame(rows, schema)).orderBy("claim_id").collect()
    assert (a["source_file"], a["reference"], a["amount"], a["partial_date"], a["timestamp"]) == ("shot.png", "123456789012", Decimal("50.00"), "2026-04-03", None)
    assert (a["conf"]["reference"], a["conf"]["amount"], a["conf"]["currency"], a["conf"]["payer_upi_id"], a["conf"]["timestamp"]) == (0.76, 0.5, 0.5, 0.5, 0.0)
    assert a["extraction_notes"].count("seen") == 1 and "timestamp not found in screenshot" not in a["extraction_notes"]
    assert (b["source_file"], b["extraction_notes"], set(b["conf"].values())) == ("unknown", [], {0.0})
    assert len(c["extraction_notes"]) == 12 and len(c["extraction_notes"][0]) == 160 and c["extraction_notes"][-1] == "... 3 more notes left out"
    assert claims.assemble(spark.createDataFrame([], schema)).count() == 0


def test_edit_hints(spark):
    h = "dhash256:" + "0" * 63
    rows = [
        (1, "a", h + "0", None, "1", 5, "Asha Rao", "t1"), (1, "b", h + "1", None, "1", 6, "Asha Rao", "t1"), (1, "c", h + "0", None, "2", 5, None, None), (1, "d", h + "0", None, "1", 5, "Asha Rao", "t1"),
        (2, "e", h + "0", "GIMP 2", "1", 7, None, None), (1, "f", None, None, None, None, None, None), (3, "g", h + "0", None, "9", 5, None, None), (3, "h", h + "0", None, "9", 5, None, None),
    ]
    frame = spark.createDataFrame(rows, "batch_id long, claim_id string, image_hash string, software string, reference string, amount int, payer_name string, ts string")
    got = {r["claim_id"]: (r["signal"], r["signals"], r["confidence"]) for r in claims.edit_hints(frame).collect()}
    one = ("medium", 2, 0.55)
    assert got == {"a": one, "d": one, "b": one, "c": ("low", 2, 0.3), "e": ("medium", 1, 0.5), "f": ("none", 0, 0.0), "g": ("none", 0, 0.0), "h": ("none", 0, 0.0)}


def test_payer_reply(spark):
    rows = spark.createDataFrame([("Verified", "en", "Asha", Decimal(1500), "12"), ("Duplicate", "hi", None, None, None), ("Other", "te", "x", Decimal(1), None)], "s string, l string, n string, a decimal(18,2), r string")
    got = [x[0] for x in rows.select(followup.payer_reply(*map(F.col, "slnar"))).collect()]
    assert got[0].startswith("Hello Asha, your payment of ₹1,500.00 with reference 12 has") and got[2] is None
    assert got[1].startswith("नमस्ते, यही भुगतान किसी")
