"""The intake as a stream: messages in, screened records and alerts out; unresolved claims wait for newer statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofrecon.operators.followup import RESOLVED, to_recheck, unconsumed_rows
from proofrecon.operators.intake import policy
from proofrecon.operators.matching import prepared_claims, prepared_rows, verify
from proofrecon.storage import settle


def _timed(messages: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with a zone; zone-free times are read in the session's."""
    return messages.withColumn("created_at", F.col("created_at").cast("timestamp"))


def screened(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    """A message stream with policy columns, each id once within the watermark."""
    once = _timed(messages).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])
    return policy(once)


def daily_counts(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Decisions per day, late messages within the watermark included."""
    out = policy(_timed(messages).withWatermark("created_at", delay))
    return out.groupBy(F.window("created_at", "1 day").alias("day"), "decision").agg(F.count("*").alias("n"))


def start_intake(messages: DataFrame, records: str, alerts: str, checkpoint: str) -> StreamingQuery:
    """Write accepted records and alerts, a folder per micro-batch, so that a repeated batch replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("decision = 'accept'").write.mode("overwrite").parquet(f"{records}/batch={number}")
        batch.where("decision <> 'accept'").write.mode("overwrite").parquet(f"{alerts}/batch={number}")
        batch.unpersist()

    return screened(messages).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).start()


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """Of the stored verdicts (with the number of their micro-batch) each claim's last one."""
    whole = F.struct(*(c for c in verdicts.columns if c != "batch"))
    return verdicts.groupBy("batch_id", "claim_id").agg(F.max_by(whole, "batch").alias("v")).select("v.*")


def start_recheck(rows: DataFrame, claims: DataFrame, verdicts: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of statement rows judges the unresolved claims of its statements anew; a claim never expires into a verdict.

    Rows are kept beside the verdicts (``verdicts``_rows), as a statement may arrive in parts: claims meet all stored rows
    that no resolved claim has used, and coverage spans all stored rows. The statement's parse_confidence may come as a
    column of ``rows``; the least of its parts counts. A folder per micro-batch holds the verdicts that are new in it;
    ``latest_verdicts`` merges them. A repeated micro-batch sees what it saw before and replaces itself.
    """
    kept = f"{verdicts}_rows"

    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{kept}/batch={number}")
        stored = spark.read.parquet(kept).where(F.col("batch") <= number)
        touched = stored.where(F.col("batch") == number).select("batch_id").distinct()
        stored = settle(stored.drop("batch").join(touched, "batch_id", "left_semi").distinct())
        read = F.min("parse_confidence") if "parse_confidence" in stored.columns else F.lit(None).cast("double")
        meta = stored.groupBy("batch_id").agg(F.min("dt").alias("coverage_start"), F.max("dt").alias("coverage_end"), read.alias("parse_confidence"), F.count("*").alias("n_rows"))
        mine, left = claims.join(touched, "batch_id", "left_semi"), stored
        if number > 0:
            old = settle(latest_verdicts(spark.read.parquet(verdicts).where(F.col("batch") < number)))
            free = unconsumed_rows(prepared_rows(stored), prepared_claims(mine), old)
            used = old.where(F.col("status").isin(*RESOLVED)).select("batch_id", "row_id")
            left = stored.join(free.join(used, ["batch_id", "row_id"], "left_anti"), ["batch_id", "row_id"], "left_semi")
            mine = to_recheck(mine, old)
        verify(mine, left, meta).write.mode("overwrite").parquet(f"{verdicts}/batch={number}")

    return rows.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).start()


def replay(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file stream over parquet messages."""
    return spark.readStream.schema(schema).parquet(path)
