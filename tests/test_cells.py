"""Golden tables of the scalar functions."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from proofrecon.functions import amounts, dates, names, references, text

AMOUNTS = {
    "(₹ 70/-)": Decimal("-70.00"), "2 345,67": Decimal("2345.67"), "\u2212USD 3": Decimal("-3.00"), "Cr: 4,321.00": Decimal("4321.00"), "-0": Decimal("0.00"),
    "1,50,000.00": Decimal("150000.00"), "150,000": Decimal("150000.00"), "1.234,56": Decimal("1234.56"), "1234,5": Decimal("1234.50"), "₹ 500/-": Decimal("500.00"),
    "(2.675)": Decimal("-2.68"), "12-": Decimal("-12.00"), "+7": Decimal("7.00"), "0.005": Decimal("0.01"), ".5": Decimal("0.50"), "1.234.567": Decimal("1234567.00"), "Rs. 10 Dr": Decimal("10.00"),
}
REFUSED = ("2,345,67", "3,1000", "2e4", "--7", "8*", "Cr 5 Dr", "(5", "04/03/2027", "10:15", "Dr", "1,2,3", "abc", "12,34.5.6", "1,50,00.00x")
EMPTY = ("", "-", "nil", "N/A", None, "INR")


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_amounts(spark):
    assert column(spark, list(AMOUNTS), lambda x: amounts.parse_amount(x)["value"]) == list(AMOUNTS.values())
    assert set(column(spark, REFUSED, lambda x: amounts.parse_amount(x)["status"])) == {"invalid"}
    assert set(column(spark, EMPTY, lambda x: amounts.parse_amount(x)["status"])) == {"empty"}
    assert column(spark, ["5 Dr", "Cr 5", "5 d", "5"], lambda x: amounts.parse_amount(x)["marker"]) == ["dr", "cr", "dr", None]


@pytest.mark.parametrize(
    ("cell", "order", "dt", "timed"),
    [
        ("29.02.2028", "dmy", datetime(2028, 2, 29), False),
        ("Wednesday 29-FEB-28 00:00:00", "dmy", datetime(2028, 2, 29), True),
        ("1st Sept 2027", "dmy", datetime(2027, 9, 1), False),
        ("2027/03/04T11:12:13+05:30", "mdy", datetime(2027, 3, 4, 11, 12, 13), True),
        ("20270304", "dmy", datetime(2027, 3, 4), False),
        ("4/3/69 12:30 am", "dmy", datetime(2069, 3, 4, 0, 30), True),
        ("04/03/2027 24:10", "dmy", None, False),
        ("04/03/20277", "dmy", None, False),
        ("Page 2 of 5", "dmy", None, False),
        ("14:05", "dmy", None, False),
        ("06/10/2026", "dmy", datetime(2026, 10, 6), False),
        ("06/10/2026", "mdy", datetime(2026, 6, 10), False),
        ("2026-10-06T14:05:09Z", "dmy", datetime(2026, 10, 6, 14, 5, 9), True),
        ("Tue, 6 Oct 26 2:05 PM", "dmy", datetime(2026, 10, 6, 14, 5), True),
        ("Oct 6, 2026", "dmy", datetime(2026, 10, 6), False),
        ("061070", "dmy", None, False),
        ("01-01-70", "dmy", datetime(1970, 1, 1), False),
        ("31/02/2026", "dmy", None, False),
        ("06/10/2026 13:00 PM", "dmy", None, False),
        (None, "dmy", None, False),
    ],
)
def test_dates(spark, cell, order, dt, timed):
    got = column(spark, [cell], lambda x: dates.parse_datetime(x, order))[0]
    assert (got["dt"], got["has_time"]) == (dt, timed)


def test_references(spark):
    cells = ["UTR: 123456789012 x", "UPI/123456789012/Asha", "UPI/123456789012/999988887777", "123456789012", "123456789012 210987654321", "1234567890123", None]
    got = column(spark, cells, references.extract_reference)
    assert [(g["value"], g["confidence"]) for g in got] == [("123456789012", "high")] * 2 + [("123456789012", "medium")] * 2 + [("123456789012", "low")] + [(None, None)] * 2
    assert column(spark, ["1234-5678 9012", "111111111111", "12", None], references.normal_reference) == ["123456789012", None, None, None]
    assert column(spark, ["UPI/1234/ASHA RAO/a@bank", "NEFT-oksbi-Mr Ravi Das", "UPI/12345", None], references.name_hint) == ["Asha Rao", "Ravi Das", None, None]


def test_text(spark):
    assert column(spark, [" a \n b ", None], text.clean_cell) == ["a b", ""]
    assert column(spark, ["UPI/12 Asha", None], text.mask_cell) == ["UPI/99 Xxxx", None]
    assert column(spark, ["1234567.5", "-12", "999"], lambda x: text.indian_grouping(x.cast("decimal(18,2)"))) == ["₹12,34,567.50", "-₹12.00", "₹999.00"]


def test_hamming(spark):
    a = "f" * 64
    rows = spark.createDataFrame([(a, a), (a, "e" + "f" * 63), (a, "0" * 64), (a, "xyz")], "a string, b string")
    assert [r[0] for r in rows.select(references.hamming256(F.col("a"), F.col("b"))).collect()] == [0, 1, 256, None]


def test_names():
    assert names.similarity("Mr Asha Rao", "rao asha") == 1.0
    assert names.similarity("Ali", "Ali Khan") < 0.75
    assert names.similarity("A Rao", "Asha Rao") == 0.8
    assert names.similarity("", "x") is None
    assert names.similarity("Asha Devi Rao", "Rao Asha Devi") == 1.0
    assert 0.85 < names.similarity("Meera Pillai", "Meera Pilai") < 1.0
    assert names.similarity("Asha Rao", "Vikram Sen") == 0.0


def test_times_and_order(spark):
    assert column(spark, ["12:05:09 AM", "23:59:59", "25:00", "04/03/2027 1:05 pm", "x 10:00", None], dates.parse_time) == [309, 86399, None, 47100, None, None]
    cells = {("13/10/2026", "01/10/2026"): "dmy:certain", ("10/13/2026", "10/01/2026"): "mdy:certain", ("01/10/2026",): "dmy:assumed", ("13/10/2026", "10/13/2026"): "dmy:conflict", ("2026-10-13", "06-Oct-2026"): "dmy:certain"}
    for rows, told in cells.items():
        votes = spark.createDataFrame([(c,) for c in rows], "x string").agg(*dates.date_order_votes(F.col("x")))
        assert votes.select(dates.date_order()).first()[0] == told
