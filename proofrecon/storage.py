"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` below spark.checkpoint.dir (where that is unset, a temporary folder, which only local mode may use) and read it back.

    A result that several branches use is then computed once, and survives executors that are lost later.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="proofrecon-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_rows(df: DataFrame) -> DataFrame:
    """``settle`` for a table with a row per claim, edge or statement row: joins with it sort and merge.

    Spark plans by the size of files, which hold such rows in a small part of what they take in memory (and counts no rows
    that an explode adds), so it would send tables of millions of rows through the driver to broadcast them.
    """
    return settle(df).hint("merge")
