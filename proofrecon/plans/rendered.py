"""Statements of v_stmt rendered in fourteen layouts as lines of cells, and queries that read them back to rows and proofs.

A batch's layout is batch_id % 14. Times are told to the second; amounts and balances as each layout writes them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofrecon.functions.text import indian_grouping
from proofrecon.operators import matching
from proofrecon.operators.statements import chain_wording, judged_mappings, mappings_of, read_flow, scanned_rows
from proofrecon.operators.tables import find_header
from proofrecon.plans.views import view
from proofrecon.storage import settle

LAYOUTS = ("standard", "marked", "signed", "timed", "currency", "junk", "wrapped", "decimal_comma", "newest_first", "inverted", "no_balance", "no_header", "above", "paged")
#: Lines between the rows of a statement, so that a layout can put some above, between and below them.
STEP = 10


def rendered_cells(stmt: DataFrame) -> DataFrame:
    """file, line, cells of every batch."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    money = F.coalesce("credit", "debit")
    inward = F.col("credit").isNotNull()
    day, clock = F.date_format("dt", "dd/MM/yyyy"), F.date_format("dt", "HH:mm:ss")
    stamp = F.concat(day, F.lit(" "), clock)
    indian = lambda c: F.translate(indian_grouping(F.col(c)), "₹", "")
    comma = lambda c: F.coalesce(F.translate(F.format_number(F.col(c).cast("decimal(18,2)"), 2), ",.", ".,"), F.lit(""))
    sign = lambda c: F.when(c, "").otherwise("-")
    whole, part = F.col("narration"), F.substring("narration", 1, 10)
    rest = F.substring(F.col("narration"), F.lit(11), F.lit(200))
    cut = F.col("ref").isNotNull()

    def line(at: int | Column, *cells: Column | str) -> Column:
        at = at if isinstance(at, Column) else F.col("k") * STEP + 100 + at
        return F.struct(at.cast("long").alias("line"), F.array(*(F.lit(c) if isinstance(c, str) else c for c in cells)).alias("cells"))

    two = lambda *head: F.array(line(0, *head, text("debit"), text("credit"), text("balance")))
    marked = F.concat(money.cast("string"), F.when(inward, " Cr").otherwise(" Dr"))
    signed = F.concat(sign(inward), money.cast("string"))
    rupee = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("₹ "), indian(c))).otherwise("")
    wrapped = [line(0, stamp, F.when(cut, part).otherwise(whole), text("debit"), text("credit"), text("balance"))]
    dated = line(2, stamp, "", text("debit"), text("credit"), text("balance"))
    body = (
        two(stamp, whole, text("ref"), day),
        F.array(line(0, stamp, whole, marked, F.concat(indian("balance"), F.lit(" Cr")))),
        F.array(line(0, stamp, whole, signed, text("balance"))),
        two(F.date_format("dt", "dd-MMM-yyyy"), clock, whole),
        F.array(line(0, stamp, whole, rupee("debit"), rupee("credit"), rupee("balance"))),
        two(stamp, whole),
        F.array_compact(F.array(*wrapped, F.when(cut, line(1, "", rest, "", "", "")))),
        F.array(line(0, stamp, whole, comma("debit"), comma("credit"), comma("balance"))),
        F.array(line(900_000 - F.col("k") * STEP, stamp, whole, money.cast("string"), F.when(inward, "CREDIT").otherwise("DEBIT"), text("balance"))),
        F.array(line(0, stamp, whole, F.concat(sign(~inward), money.cast("string")), text("balance"))),
        F.array(line(0, stamp, whole, text("debit"), text("credit"))),
        two(stamp, whole),
        F.array_compact(F.array(line(0, "", F.when(cut, part).otherwise(whole), "", "", ""), F.when(cut, line(1, "", rest, "", "", "")), dated, line(3, "", F.concat(F.lit("Chq: "), F.coalesce("ref", F.lit("none"))), "", "", ""))),
        F.array_compact(F.array(line(0, stamp, whole, text("debit"), text("credit"), text("balance")), F.when(F.col("k") % 40 == 39, line(1, "Date", "Narration", "Debit", "Credit", "Balance")))),
    )
    five = ("Date", "Narration", "Debit", "Credit", "Balance")
    heads = (
        ("Date", "Narration", "Chq/Ref No", "Value Date", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance"), ("Date", "Description", "Amount", "Balance"), ("Txn Date", "Details", "Amount", "Running Balance"),
        ("Date", "Time", "Particulars", "Debit", "Credit", "Balance"), five, five, five, five, ("Date", "Narration", "Amount", "Type", "Balance"), ("Txn Date", "Details", "Amount", "Balance"), ("Date", "Narration", "Debit", "Credit"), None, five, five,
    )
    layout = (F.col("batch_id") % len(LAYOUTS)).cast("int")
    own = reduce(lambda told, k: told.when(layout == k, body[k].cast("array<struct<line:bigint,cells:array<string>>>")), range(len(body)), F)  # only the row's own layout is written
    rows = stmt.select(F.col("batch_id").alias("file"), F.explode(own).alias("x")).select("file", "x.*")

    ends = stmt.groupBy("batch_id").agg(F.min_by("balance", "k").alias("_b"), F.min_by(F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0)), "k").alias("_m"))
    at = lambda n: F.lit(n)
    extra = [[line(at(50), *head)] if head else [] for head in heads]
    opening = line(at(60), "", "Opening Balance", "", "", (F.col("_b") - F.col("_m")).cast("string"))
    extra[5] = [line(at(1), "Bank of Somewhere", "", "", "", ""), line(at(2), "Account", "12345", "Period", "2024", ""), line(at(3), "Statement of account", "", "", "", ""), *extra[5], opening,
                line(at(900_001), "", "Closing Balance", "", "", "0.00"), line(at(900_002), "", "Nothing follows", "", "", ""), line(at(900_003), "This is a computer generated statement", "", "", "", "")]
    lines = F.get(F.array(*((F.array(*e) if e else F.array()).cast("array<struct<line:bigint,cells:array<string>>>") for e in extra)), layout)
    return rows.unionByName(ends.select(F.col("batch_id").alias("file"), F.explode(lines).alias("x")).select("file", "x.*"))


#: The layouts whose balance, order or narration come out otherwise than v_stmt has them, as SQL over v_stmt s.
_LAYOUT = f"batch_id % {len(LAYOUTS)}"
_WRAPPED = f"CASE WHEN {_LAYOUT} IN (6, 12) AND ref IS NOT NULL THEN concat(substr(narration, 1, 10), substr(narration, 11)) ELSE narration END"
_TRUTH = f"""SELECT *, {_LAYOUT} AS layout, date_trunc('second', dt) AS told_at, CASE WHEN {_LAYOUT} <> 10 THEN balance END AS shown,
 concat({_WRAPPED}, CASE WHEN {_LAYOUT} = 12 THEN concat(' Chq: ', coalesce(ref, 'none')) ELSE '' END) AS told FROM v_stmt"""

ROWS_SQL = f"""
SELECT batch_id AS file, concat('S', lpad(CAST(k + 1 AS STRING), 5, '0')) AS statement_row, told_at AS dt, told AS narration, CAST(round(debit * 100) AS BIGINT) AS debit, CAST(round(credit * 100) AS BIGINT) AS credit,
 CAST(round(shown * 100) AS BIGINT) AS balance, ref, CASE WHEN ref IS NOT NULL THEN 'high' END AS ref_confidence FROM ({_TRUTH}) t"""


def _cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long").alias(name)


def q72_parse_rows(spark, sf_dir) -> DataFrame:
    """Typed rows of all statements in fourteen layouts, from cells to references, without any told mapping."""
    rows = read_flow(rendered_cells(view(spark, sf_dir, "v_stmt"))).rows
    return rows.select("file", "statement_row", "dt", "narration", _cents("debit"), _cents("credit"), _cents("balance"), "ref", "ref_confidence")


META_SQL = f"""
WITH s AS (SELECT batch_id AS file, layout, count(*) AS n, min(told_at) AS a, max(told_at) AS b, count(ref) AS refs, count(CASE WHEN CAST(extract(day FROM told_at) AS INT) > 12 THEN 1 END) AS sure FROM ({_TRUTH}) t GROUP BY batch_id, layout),
m AS (SELECT *, CASE layout WHEN 10 THEN 0 WHEN 5 THEN n ELSE n - 1 END AS checked, CASE WHEN layout = 10 THEN 0.60 WHEN n - 1 < 10 THEN 0.85 ELSE 0.97 END - CASE WHEN layout <> 3 AND sure = 0 THEN 0.03 ELSE 0 END - CASE WHEN layout = 11 THEN 0.10 ELSE 0 END AS conf FROM s)
SELECT file, a AS coverage_start, b AS coverage_end, n AS row_count, CASE WHEN layout = 10 THEN 'unavailable' ELSE 'pass' END AS status, checked, checked AS passed, layout = 9 AS flipped, layout = 8 AS newest_first, layout = 11 AS synthesized,
 CAST(round(conf * 100) AS BIGINT) AS confidence, layout = 10 OR conf < 0.8 AS needs_confirmation, CASE WHEN layout = 5 THEN 3 ELSE 0 END + CASE WHEN layout = 13 THEN n // 40 ELSE 0 END AS n_skipped, 0 AS n_lost FROM m"""


def q71_best_mapping(spark, sf_dir) -> DataFrame:
    """What was chosen for each statement and how its balance proves it: exchanged, order, header, confidence."""
    meta = read_flow(rendered_cells(view(spark, sf_dir, "v_stmt"))).meta
    return meta.select("file", "coverage_start", "coverage_end", "row_count", "status", "checked", "passed", "flipped", "newest_first", "synthesized", F.round(F.col("parse_confidence") * 100).cast("long").alias("confidence"), "needs_confirmation", "n_skipped", "n_lost")


ATTEMPTS_SQL = f"""
WITH s AS (SELECT batch_id AS file, layout, count(*) AS n FROM ({_TRUTH}) t GROUP BY batch_id, layout)
SELECT file, false AS flipped, CASE layout WHEN 10 THEN 'unavailable' WHEN 9 THEN 'fail' ELSE 'pass' END AS status FROM s UNION ALL SELECT file, true, CASE layout WHEN 10 THEN 'unavailable' ELSE 'pass' END FROM s WHERE layout IN (9, 10)"""


def q71b_attempts(spark, sf_dir) -> DataFrame:
    """Every candidate mapping of every statement with the result of its balance chain."""
    return judged_mappings(rendered_cells(view(spark, sf_dir, "v_stmt")))[-1].select("file", "flipped", "status")


KINDS_SQL = f"""
WITH s AS (SELECT batch_id AS file, layout, count(*) AS n, count(ref) AS refs FROM ({_TRUTH}) t GROUP BY batch_id, layout)
SELECT file, 'transaction' AS kind, n FROM s UNION ALL SELECT file, 'below', refs FROM s WHERE layout = 6 AND refs > 0 UNION ALL SELECT file, 'above', n + refs FROM s WHERE layout = 12
UNION ALL SELECT file, 'below', n FROM s WHERE layout = 12 UNION ALL SELECT file, 'repeated_header', n // 40 FROM s WHERE layout = 13 AND n >= 40
UNION ALL SELECT file, kind, m FROM s, (VALUES ('opening', 1), ('footer', 1), ('footer_text', 2)) v(kind, m) WHERE layout = 5"""


def q72b_row_kinds(spark, sf_dir) -> DataFrame:
    """How many rows of each kind the scan finds in each statement."""
    cells = settle(rendered_cells(view(spark, sf_dir, "v_stmt")))
    return scanned_rows(cells, settle(mappings_of(cells, settle(find_header(cells))))).groupBy("file", "kind").agg(F.count("*").alias("n"))


VERIFY_SQL = f"""
WITH t AS ({_TRUTH}), c AS (SELECT *, CASE WHEN status_shown = 'failed' THEN 1 ELSE 0 END AS bad FROM v_claims WHERE currency = 'INR' AND reference IS NOT NULL)
SELECT c.claim_id, concat('S', lpad(CAST(t.k + 1 AS STRING), 5, '0')) AS statement_row, concat_ws(',', CASE WHEN t.credit <> c.amount THEN 'amount' END, CASE WHEN c.bad = 1 THEN 'status_shown' END,
 CASE WHEN abs(epoch_us(c.ts) - epoch_us(t.told_at)) > 86400000000 THEN 'timestamp' END) AS fields FROM c JOIN t ON t.batch_id = c.batch_id AND t.ref = c.reference AND t.credit IS NOT NULL"""


def q44b_flow_hits(spark, sf_dir) -> DataFrame:
    """Claims against the rows that the flow read from the rendered statements: reference hits and their conflicts."""
    flow = read_flow(rendered_cells(view(spark, sf_dir, "v_stmt")))
    rows = matching.prepared_rows(flow.rows.select(F.col("file").alias("batch_id"), F.col("statement_row").alias("row_id"), "dt", "narration", "debit", "credit", "ref", "name_hint"))
    claims = matching.prepared_claims(view(spark, sf_dir, "v_claims")).where("c_currency = 'INR'")
    hits = matching.with_evidence(matching.reference_hits(claims, rows), names=False)
    fields = F.array_join(F.array_sort(F.transform(matching.conflicts(), lambda d: d["field"])), ",")
    return hits.select("claim_id", F.col("row_id").alias("statement_row"), fields.alias("fields"))


def q79b_chain_wording(spark, sf_dir) -> DataFrame:
    """The proof of each statement in words."""
    return read_flow(rendered_cells(view(spark, sf_dir, "v_stmt"))).meta.select("file", chain_wording().alias("proof"))


WORDING_SQL = f"""
SELECT batch_id AS file, CASE WHEN layout = 10 THEN 'There is no balance to prove the rows with.' ELSE concat('The balance follows on ', count(*) - CASE WHEN layout = 5 THEN 0 ELSE 1 END, ' of ', count(*) - CASE WHEN layout = 5 THEN 0 ELSE 1 END, ' rows (',
 CASE WHEN layout = 8 THEN 'newest' ELSE 'oldest' END, ' first).') END AS proof FROM ({_TRUTH}) t GROUP BY batch_id, layout"""

QUERIES = {
    "q72_parse_rows": (q72_parse_rows, ROWS_SQL),
    "q72b_row_kinds": (q72b_row_kinds, KINDS_SQL),
    "q71_best_mapping": (q71_best_mapping, META_SQL),
    "q71b_attempts": (q71b_attempts, ATTEMPTS_SQL),
    "q44b_flow_hits": (q44b_flow_hits, VERIFY_SQL),
    "q79b_chain_wording": (q79b_chain_wording, WORDING_SQL),
}
