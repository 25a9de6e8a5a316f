"""Tests of the findings of round 4."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from proofrecon.functions import amounts, dates
from proofrecon.operators import statements
from proofrecon.operators.tables import find_header
from proofrecon.plans.catalogue import ORACLES, QUERIES
from proofrecon.plans.rendered import rendered_cells
from proofrecon.plans.views import view
from tests.conftest import DATA


def events(folder, keep="true", ids="event_id", users="user_id"):
    """A folder with a table of events like the smallest one, with other ids."""
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST({ids} AS BIGINT) AS event_id, CAST({users} AS BIGINT) AS user_id) FROM '{DATA}/events.parquet' WHERE {keep} ORDER BY event_id) TO '{folder}/events.parquet'")
    return str(folder)


def in_sql(name, folder):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet'")
    return con.sql(ORACLES[name]).df()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_are_not_broadcast(spark):
    """files of hashes and links are small, what they hold in memory is not."""
    assert "10485760" in spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    text = plan(QUERIES["q48b_all_duplicate_links"](spark, DATA))
    assert "Window" in text and "BroadcastHashJoin" not in text
    hashed = spark.sql("SELECT 1 AS batch_id, concat(lpad(id, 2, '0'), repeat('0', 62)) AS h FROM range(20)")
    from proofrecon.operators.matching import _near_classes

    near = _near_classes(hashed, 6)
    assert "SortMergeJoin" in plan(near) and "BroadcastHashJoin" not in plan(near)
    assert near.count() == 190


def test_no_other_reference_is_near_by_chance(spark, tmp_path):
    """references that read the same from behind met what was made from them."""
    folder = events(tmp_path, keep="event_id < 3", ids="CASE event_id WHEN 0 THEN 963054 WHEN 1 THEN 967614 ELSE 2222874 END")
    got = QUERIES["q36_near_reference"](spark, folder).collect()
    assert sorted((r["pos"], r["digits"]) for r in got) == [(963054, None), (967614, None), (2222874, None)]
    assert in_sql("q36_near_reference", folder)["digits"].isna().all()


@pytest.mark.parametrize("name", ["verify_all_claims", "verify_claims"])
def test_verdicts_are_not_broadcast(spark, name):
    """no join on claims goes through the driver."""
    text = plan(QUERIES[name](spark, DATA))
    assert re.search(r"SortMergeJoin \[batch_id#\d+L?, claim_id#", text)
    assert not re.search(r"BroadcastHashJoin \[batch_id#\d+L?, claim_id#", text)


def test_cells_that_are_hardly_dates(spark):
    """cells without a digit or with other signs are not taken apart, and mean what they meant before."""
    cells = {"Mon(x) 12/01/2024": (True, False), "12@01/2024": (False, False), "fri@ 12/01/2024": (True, False), "UPI/100000000000/Asha Rao/user1@bank": (False, False), "": (False, False),
             "10:20": (False, True), "T 10:20": (False, False), "12/01/2024 25:00": (False, False), "31/02/2024": (False, False), "13/13/2024": (False, False), "02/31/2024": (False, False), "Paid (10:20)": (False, False)}
    frame = spark.createDataFrame([(c,) for c in cells], "x string")
    like = dates.date_and_time_like(F.col("x"))
    got = {r["x"]: r for r in frame.select("x", like["date"].alias("d"), like["time"].alias("t"), dates.is_date_like(F.col("x")).alias("d1"), dates.is_time_like(F.col("x")).alias("t1"), amounts.is_amount_like(F.col("x")).alias("m")).collect()}
    assert {c: (r["d"], r["t"]) for c, r in got.items()} == cells == {c: (r["d1"], r["t1"]) for c, r in got.items()}


def test_lines_below_a_sure_header_are_not_parsed(spark, tmp_path):
    """lines are searched for data only in files that have none near their top, as that test was pushed below the join."""
    row = ["12/01/2024", "a", "1.00", ""]
    cells = [(1, 1, ["Date", "Narration", "Amount", "Balance"]), *((1, k, row) for k in range(2, 9)), *((2, k, ["nothing", "at all", "", ""]) for k in range(1, 100)), (2, 100, row), (3, 1, ["x", "", "", ""])]
    found = find_header(spark.createDataFrame(cells, "file int, line int, cells array<string>"))
    text = found._jdf.queryExecution().optimizedPlan().toString()
    tests = [line for line in text.splitlines() if "exists(cells" in line and "WindowGroupLimit" not in line and "regexp_extract_all" in line]
    assert "LeftSemi" not in text and len(tests) == 1 and "CASE WHEN NOT sure" in tests[0]
    assert sorted((r["file"], r["header_line"], r["data_from"]) for r in found.collect()) == [(1, 1, 2), (2, None, 100)]


def test_a_row_is_written_in_its_own_layout_only(spark):
    """all fourteen layouts were made of each row, and one was taken."""
    text = rendered_cells(view(spark, DATA, "v_stmt"))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(CASE WHEN (cast((batch_id" in text


def test_attempts_need_no_typed_rows(spark, monkeypatch):
    """references and names of all rows were read before their attempts could be shown."""
    monkeypatch.setattr(statements, "name_hint", None)
    got = QUERIES["q71b_attempts"](spark, DATA)
    assert {(r["flipped"], r["status"]) for r in got.collect()} == {(False, "pass")}
