"""Shared plumbing: scratch tables in the cluster's shared folder, bounded Arrow chunks, ranks without a global sort task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that a Python worker holds as NumPy arrays at a time (a longer document is a chunk of its own).
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, below a temporary folder, which only local mode may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="proofrecon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a short lineage that outlives any executor."""
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose ``text`` column has about ``most`` bytes; no row is split or lost."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for row, size in enumerate(sizes.tolist()):
            if total and total + size > most:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # a worker stays, idle, beside the tasks of later stages


def encoded(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``rank`` (from 1) in each ``group`` by ``order``, however large a group is.

    Rows are range-partitioned by group and order, so a hot group spreads over many tasks. Each (partition, group) run
    is contiguous; only the run lengths, at most partitions + groups of them, are summed up to give each run its base.
    """
    pos = F.monotonically_increasing_id()
    sorted_rows = cut(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_pos", pos))
    sorted_rows = sorted_rows.withColumn("_part", F.shiftright("_pos", 33))
    runs = sorted_rows.groupBy(group, "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_run"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.withColumn("_base", F.coalesce(F.sum("_run").over(before), F.lit(0)))
    base = cut(base.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_first", "_base"))
    joined = sorted_rows.join(base, sorted_rows[group].eqNullSafe(base["_g"]) & (sorted_rows["_part"] == base["_p"]))
    return joined.withColumn("rank", F.col("_pos") - F.col("_first") + F.col("_base") + 1).drop("_pos", "_part", "_g", "_p", "_first", "_base")
