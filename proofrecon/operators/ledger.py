"""Statement proofs: balance chain, reading order, coverage, parse confidence, preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def balance_chain(rows: DataFrame, *, file: str = "batch_id", order: str = "pos", opening: Column | None = None) -> DataFrame:
    """Per file: checked, passed, first break, pass rate, status and evidence of balance = previous + credit - debit.

    A null balance resets the chain; the opening balance, if any, stands before the first row. The file is the window's
    key, and a statement is bounded, so a window holds one statement.
    """
    w = Window.partitionBy(file).orderBy(order)
    before = F.lag("balance").over(w)
    if opening is not None:
        before = F.when(F.row_number().over(w) == 1, opening).otherwise(before)
    moved = F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))
    steps = rows.withColumn("_gap", F.abs(F.col("balance") - (before + moved)))
    checked, good = F.col("_gap").isNotNull(), F.col("_gap") <= 0.01
    out = steps.groupBy(file).agg(
        F.count_if(checked).alias("checked"), F.count_if(good).alias("passed"), F.min(F.when(checked & ~good, F.col(order))).alias("first_break"), F.count("*").alias("n_rows")
    )
    rate = F.col("passed") / F.nullif("checked", F.lit(0))
    status = F.when(F.col("checked") == 0, "unavailable").when(F.col("passed") == F.col("checked"), "pass").when(rate >= 0.9, "partial").otherwise("fail")
    return out.withColumn("status", status).withColumn("evidence", F.when(F.col("checked") >= 10, "strong").otherwise("weak"))


def reading_order(rows: DataFrame, *, file: str = "batch_id", order: str = "pos") -> DataFrame:
    """Whether a file reads top-down or bottom-up, by which direction passes more chain steps; ties by the dates' trend."""
    w = Window.partitionBy(file).orderBy(order)
    moved = F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))
    down = F.abs(F.col("balance") - (F.lag("balance").over(w) + moved)) <= 0.01
    up = F.abs(F.col("balance") - (F.lead("balance").over(w) + moved)) <= 0.01
    later = (F.col("dt") > F.lag("dt").over(w)).cast("int") - (F.col("dt") < F.lag("dt").over(w)).cast("int")
    votes = rows.select(file, down.alias("down"), up.alias("up"), later.alias("later"))
    out = votes.groupBy(file).agg(F.count_if("down").alias("n_down"), F.count_if("up").alias("n_up"), F.coalesce(F.sum("later"), F.lit(0)).alias("trend"))
    newest = (F.col("n_up") > F.col("n_down")) | ((F.col("n_up") == F.col("n_down")) & (F.col("trend") < 0))
    return out.withColumn("direction", F.when(newest, "newest_first").otherwise("oldest_first"))


def coverage(rows: DataFrame, *, file: str = "batch_id") -> DataFrame:
    """First and last time of a statement; a statement without times covers whole days. Times count if half the rows have one."""
    midnight = F.col("dt") == F.date_trunc("day", F.col("dt")).cast("timestamp_ntz")
    out = rows.groupBy(file).agg(F.min("dt").alias("a"), F.max("dt").alias("b"), F.count_if(~midnight).alias("timed"), F.count("dt").alias("dated"))
    has_time = 2 * F.col("timed") >= F.col("dated")
    day = lambda c: F.date_trunc("day", F.col(c)).cast("timestamp_ntz")
    start = F.when(has_time, F.col("a")).otherwise(day("a"))
    end = F.when(has_time, F.col("b")).otherwise(day("b") + F.make_dt_interval(secs=F.lit(86_399)))
    return out.select(file, start.alias("coverage_start"), end.alias("coverage_end"), has_time.alias("has_time_of_day"))


def position_in_coverage(ts: Column, start: Column, end: Column, hours: int = 24) -> Column:
    near = end - F.make_dt_interval(hours=F.lit(hours))
    return F.when(ts.isNull() | start.isNull() | end.isNull(), "unknown").when(ts < start, "before").when(ts > end, "after").when(ts > near, "near_end").otherwise("inside")


#: Confidence that a chain status starts from.
BASE = {"pass": 0.97, "weak": 0.85, "partial": 0.70, "unavailable": 0.60, "fail": 0.30}


def parse_confidence(status: Column, evidence: Column, parse_rate: Column, penalty: Column) -> Column:
    kind = F.when((status == "pass") & (evidence == "weak"), "weak").otherwise(status)
    base = F.lit(0.0)
    for name, value in BASE.items():
        base = F.when(kind == name, value).otherwise(base)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * parse_rate - penalty)), 4)


def preview(rows: DataFrame, *, file: str = "batch_id") -> DataFrame:
    """Counts and totals of money in and out."""
    return rows.groupBy(file).agg(
        F.count("credit").alias("n_in"), F.coalesce(F.sum("credit"), F.lit(0)).alias("money_in"), F.count("debit").alias("n_out"), F.coalesce(F.sum("debit"), F.lit(0)).alias("money_out")
    )


def assemble(rows: DataFrame, *, file: str = "batch_id", order: str = "pos") -> DataFrame:
    """Chronological row ids and how often a reference occurs in its file."""
    number = F.row_number().over(Window.partitionBy(file).orderBy("dt", order))
    same = F.count("ref").over(Window.partitionBy(file, "ref"))
    return rows.withColumn("statement_row", F.format_string("S%05d", number)).withColumn("ref_uses", F.when(F.col("ref").isNotNull(), same).otherwise(0))
