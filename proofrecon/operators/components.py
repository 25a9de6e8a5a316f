"""Connected components of any size by rounds of contraction, each a few joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofrecon.storage import settle_rows


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that can be reached) for each node of ``edges`` (u, v of one orderable type).

    In a round every vertex hooks to the vertex of lowest hash among itself and its neighbours, and edges move to where
    their ends hook. Hashes differ from round to round, so a long chain loses a fixed share of its vertices in each and
    takes about log(n) rounds, whatever its order. Loops and repeated edges go; a hub meets its edges only in partial
    aggregates. Nothing is collected but whether edges are left.
    """
    edges = settle_rows(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = settle_rows(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("at", F.col("node")))
    turn = 0
    while not edges.isEmpty():
        key = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("x"))  # noqa: E731, B023
        both = edges.union(edges.select("v", "u"))
        hooks = both.groupBy("u").agg(F.min(key("v")).alias("m")).select(F.col("u").alias("node"), F.least(key("u"), F.col("m"))["x"].alias("to"))
        hooks = settle_rows(hooks)
        labels = settle_rows(labels.join(hooks.select(F.col("node").alias("at"), "to"), "at", "left").select("node", F.coalesce("to", "at").alias("at")))
        moved = edges.join(hooks.select(F.col("node").alias("u"), F.col("to").alias("a")), "u").join(hooks.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
        edges = settle_rows(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        turn += 1
    least = labels.groupBy("at").agg(F.min("node").alias("component"))
    return labels.join(least, "at").select("node", "component")
