"""Connected components by repeated contraction: every vertex hooks to its smallest neighbour, edges are relabelled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofrecon.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v); component is the smallest node that can be reached.

    A round maps each vertex to the least of itself and its neighbours: groups of near-duplicates fall together in a few
    rounds, a chain whose nodes ascend takes a round a node. A hub's edges meet only in partial aggregates and in joins
    that adaptive execution can split. Nothing is collected but whether edges are left.
    """
    edges = cut(edges.where("u <> v").select("u", "v").distinct())
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("to")))
        if labels is None:
            labels = hook.select("node", F.col("to").alias("component"))
        else:
            step = hook.select(F.col("node").alias("component"), "to")
            labels = cut(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        if edges.isEmpty():
            return labels
        at_u = edges.join(hook.select(F.col("node").alias("u"), F.col("to").alias("a")), "u")
        at_v = at_u.join(hook.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
        edges = cut(at_v.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        if edges.isEmpty():
            return labels
