"""Approximate nearest neighbours by cosine with vantage-point trees, one per shard.

Unit vectors are compared by Euclidean distance, which is a metric and orders like the cosine. Each vector lies in the
cell of its nearest pivot; a cell is a shard, or several if it holds many rows. A tree's node holds a vantage point and
halves the rest by distance from it, with the least and greatest distance of either half.

By the triangle inequality a cell or half is at least ``bound`` away from a query; it is left out if bound > factor *
(distance of the k-th nearest found so far). A query first asks a shard of its own cell, and takes what it found there
along to the other cells that are left. Factor 1 is exact, a smaller factor leaves out more.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofrecon.llm.common import cut

SHARD_ROWS, LEAF, QUERY_BLOCK = 1024, 32, 2048
#: Most pivots: those vectors whose hash is lowest, a row each that the driver sends to every task. Beyond it cells hold more shards.
PIVOTS = 4096


def build(unit: np.ndarray) -> dict[str, np.ndarray]:
    """A tree over the rows of ``unit``: per node its rows' span in ``order`` (vantage point first), children and bounds."""
    order = np.arange(len(unit))
    nodes: list[list[float]] = []

    def grow(a: int, b: int) -> int:
        me = len(nodes)
        nodes.append([a, b, -1, -1, 0, 0, 0, 0])
        if b - a > LEAF:
            rows = order[a:b]
            centre = unit[rows].mean(axis=0)
            far = int(((unit[rows] - centre) ** 2).sum(axis=1).argmax())
            rows[[0, far]] = rows[[far, 0]]
            d = np.sqrt(((unit[rows[1:]] - unit[rows[0]]) ** 2).sum(axis=1))
            by = np.argsort(d, kind="stable")
            order[a + 1 : b], d = rows[1:][by], d[by]
            half = len(d) // 2
            nodes[me][4:] = [d[0], d[half - 1], d[half], d[-1]]
            nodes[me][2] = grow(a + 1, a + 1 + half)
            nodes[me][3] = grow(a + 1 + half, b)
        return me

    grow(0, len(unit))
    return {"order": order, "nodes": np.array(nodes, float)}


def search(
    tree: dict[str, np.ndarray], asks: dict[str, np.ndarray], k: int, factor: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``asks`` its k nearest of the tree's vectors: scores (-inf where there are fewer), places in the tree, and how many were compared.

    ``tree`` and ``asks`` hold vectors, ids and rows; a query's own row is no candidate. ``asks`` may hold ``known``, a
    k-th best score from elsewhere; without it a greedy descent finds a first one. Scores are cosines of the original
    vectors, summed alike in every place, so equal vectors tie; ties go to smaller ids, then rows.
    """
    vectors, queries, ids, rows_of = tree["vectors"].astype(float), asks["vectors"].astype(float), tree["ids"], tree["rows"]
    norm, query_norm = np.sqrt((vectors**2).sum(axis=1)), np.sqrt((queries**2).sum(axis=1))
    order, nodes = tree["order"], tree["nodes"]
    # places sort like (id, row), as the tree's vectors do
    score, found = np.full((len(queries), k), -np.inf), np.full((len(queries), k), len(ids))
    seen = np.zeros(len(queries), np.int64)
    known = asks.get("known", np.full(len(queries), -np.inf)).copy()

    def offer(rows: np.ndarray, which: np.ndarray) -> None:
        seen[which] += len(rows)
        for part in np.array_split(which, max(1, len(which) * len(rows) * queries.shape[1] // 4_000_000)):
            s = (queries[part, None, :] * vectors[None, rows, :]).sum(axis=2) / (query_norm[part, None] * norm[None, rows])
            s[asks["rows"][part, None] == rows_of[None, rows]] = -np.inf
            every, names = np.concatenate([score[part], s], axis=1), np.concatenate([found[part], np.broadcast_to(rows, s.shape)], axis=1)
            best = np.lexsort((names, -every), axis=1)[:, :k]
            score[part], found[part] = np.take_along_axis(every, best, axis=1), np.take_along_axis(names, best, axis=1)

    def away(which: np.ndarray, row: int) -> np.ndarray:
        cosine = (queries[which] * vectors[row]).sum(axis=1) / (query_norm[which] * norm[row])
        return np.sqrt(np.maximum(0, 2 - 2 * cosine))

    def visit(me: int, which: np.ndarray, greedy: bool) -> None:
        a, b, left, right, l0, l1, r0, r1 = nodes[me]
        if left < 0:
            offer(order[int(a) : int(b)], which)
            return
        d = away(which, order[int(a)])
        if greedy:
            near = d <= (l1 + r0) / 2
            for child, own in ((left, which[near]), (right, which[~near])):
                if len(own):
                    visit(int(child), own, True)
            return
        offer(order[int(a) : int(a) + 1], which)
        for child, lo, hi in ((left, l0, l1), (right, r0, r1)):
            bound = np.maximum(lo - d, d - hi)
            worst = np.maximum(score[which, -1], known[which])
            own = which[(bound <= factor * reach(worst) + 1e-7) | (worst == -np.inf)]
            if len(own):
                visit(int(child), own, False)

    if len(queries) and len(vectors):
        if "known" not in asks:
            visit(0, np.arange(len(queries)), True)
            known[:] = score[:, -1]
            score[:], found[:] = -np.inf, len(ids)
        visit(0, np.arange(len(queries)), False)
    return score, found, seen


def reach(score: np.ndarray) -> np.ndarray:
    """The distance of unit vectors with these cosines."""
    return np.sqrt(np.maximum(0, 2 - 2 * np.maximum(score, -1)))


def _usable(rows: DataFrame, vector: str, ask: Column) -> DataFrame:
    element = rows.schema[vector].dataType.elementType.simpleString()
    v = F.col(vector).cast("array<float>" if element == "float" else "array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(ask, F.lit(False)).alias("ask"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.withColumn("dims", F.size("v")).withColumn("row", F.monotonically_increasing_id())


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(float)
    cosine = (vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))) @ pivots.T
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def _by_dims(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dims").to_numpy()
    for d in np.unique(dims).tolist():
        yield d, batch.take(pa.array(np.flatnonzero(dims == d)))


def _placed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with the cell of the nearest pivot (-1 where no pivot has so many dimensions) and the distance from it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d, batch in _by_dims(whole):
                cell, far = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
                if d in pivots:
                    away = _distances(_matrix(batch.column("v"), d), pivots[d])
                    cell = away.argmin(axis=1)
                    far = np.take_along_axis(away, cell[:, None], axis=1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(place, f"{fields}, cell long, far double")


def _stacked(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """One row per group of ``keys`` with its vectors, ids, rows and either its tree or what its queries know."""

    def stack(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["vec_id", "row"], kind="stable")
        vectors = np.stack(pdf["v"].to_numpy())
        arrays = {"vectors": vectors, "ids": pdf["vec_id"].to_numpy(np.int64), "rows": pdf["row"].to_numpy(np.int64)}
        if what == "tree":
            unit = vectors.astype(float)
            arrays |= build(unit / np.sqrt((unit**2).sum(axis=1, keepdims=True)))
        elif "known" in pdf:
            arrays["known"] = pdf["known"].to_numpy(float)
        np.savez(out := io.BytesIO(), **arrays)
        return pd.DataFrame({**{key: pdf[key].iloc[:1] for key in keys}, what: [out.getvalue()]})

    return rows.groupBy(*keys).applyInPandas(stack, ", ".join(f"{key} long" for key in keys) + f", {what} binary")


def _asked(asks: DataFrame, index: DataFrame, blocks: int, k: int, factor: float) -> DataFrame:
    """Hits of ``asks`` in the shards that they name: row, query_id, vec_id, found (the hit's row), score; seen once per shard, without a hit."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree_bytes, ask_bytes in zip(batch.column("tree"), batch.column("asks"), strict=True):
                tree, asks = dict(np.load(io.BytesIO(tree_bytes.as_py()))), dict(np.load(io.BytesIO(ask_bytes.as_py())))
                score, found, seen = search(tree, asks, k, factor)
                some = score > -np.inf
                n = len(seen)
                own = np.concatenate([np.repeat(np.arange(n), some.sum(axis=1)), np.arange(n)])
                hit, none = found[some], np.arange(len(own)) >= some.sum()
                pad = lambda x: pa.array(np.append(x, np.zeros(n, x.dtype)), mask=none)  # noqa: B023, E731
                made = [pa.array(asks["rows"][own]), pa.array(asks["ids"][own]), pad(tree["ids"][hit]), pad(tree["rows"][hit]), pad(score[some])]
                made.append(pa.array(np.append(np.zeros(int(some.sum()), np.int64), seen)))
                yield pa.RecordBatch.from_arrays(made, names=["row", "query_id", "vec_id", "found", "score", "seen"])

    asks = asks.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)))
    pairs = index.join(_stacked(asks, ["dims", "cell", "part", "block"], "asks"), ["dims", "cell", "part"]).select("tree", "asks")
    return pairs.mapInArrow(find, "row long, query_id long, vec_id long, found long, score double, seen long")


def nearest(
    vectors: DataFrame, ask: Column, *, vector: str = "embedding", k: int = 5, factor: float = 0.18, shard_rows: int = SHARD_ROWS, pivots: int = PIVOTS
) -> DataFrame:
    """The k nearest of ``vectors`` (vec_id, vector) for each of its rows where ``ask`` holds: query_id, rank from 1, vec_id, score, visited.

    Nearness is the cosine in double precision, ties go to the smaller vec_id. Every row but the query's own is a
    candidate and in the index; rows that repeat a vec_id are rows like others and ask each. Rows without vec_id, and
    vectors that are null, empty, zero or hold null or non-finite components, take no part; vectors of different lengths
    are not compared. A query without candidates has no rows. visited is the number of vectors that the query was
    compared with. Other columns are ignored.

    Of equal vectors only the k + 1 with the smallest vec_id enter the trees, since no others can be among a query's k
    nearest. A query meets the shards that its bounds leave: on clustered vectors a few, on vectors without neighbourhoods
    a share that ``factor`` sets.
    """
    usable = cut(_usable(vectors, vector, ask))
    n = usable.count()
    heads = usable.groupBy("dims", F.xxhash64("v").alias("h")).agg(F.min("row").alias("row")).orderBy("h", "dims").limit(min(pivots, -(-n // shard_rows)))
    chosen: dict[int, list] = {}
    for r in usable.join(F.broadcast(heads.select("row")), "row").orderBy("row").select("dims", "v").collect():  # at most `pivots` rows
        chosen.setdefault(r["dims"], []).append(r["v"])
    centres = {d: np.array(rows, float) for d, rows in chosen.items()}
    centres = {d: x / np.sqrt((x**2).sum(axis=1, keepdims=True)) for d, x in centres.items()}
    placed = cut(_placed(usable, centres))

    equal = Window.partitionBy("dims", "v").orderBy("vec_id", "row")
    kept = cut(placed.withColumn("_n", F.row_number().over(equal)).where(F.col("_n") <= k + 1).drop("_n", "ask"))
    cells = kept.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi"))
    cells = cut(cells.withColumn("parts", F.ceil(F.col("n") / (2 * shard_rows))))
    hulls: dict[int, list] = {}
    for r in cells.orderBy("dims", "cell").collect():  # a row per pivot or number of dimensions
        hulls.setdefault(r["dims"], []).append((r["cell"], r["lo"], r["hi"]))
    parts = F.broadcast(cells.select("dims", "cell", "parts"))  # likewise
    index = kept.join(parts, ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    index = cut(_stacked(index, ["dims", "cell", "part"], "tree"))

    asked = placed.where("ask").select("dims", "cell", "row", "vec_id", "v")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = cut(asked.join(parts, ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("row", F.lit(2)), F.col("parts"))).drop("parts"))
    near = cut(_asked(asked, index, blocks, k, factor))
    bar = near.groupBy("row").agg(F.when(F.count("score") == k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("known"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d, batch in _by_dims(whole):
                names = np.array([c for c, _, _ in hulls[d]])
                bound = np.zeros((batch.num_rows, len(names)))
                if d in centres:
                    away = _distances(_matrix(batch.column("v"), d), centres[d])
                    nearest_pivot = away.min(axis=1, keepdims=True)
                    away = away[:, names]
                    lo, hi = (np.array([h[i] for h in hulls[d]]) for i in (1, 2))
                    bound = np.maximum.reduce([(away - nearest_pivot) / 2, away - hi, lo - away])
                known = batch.column("known").to_numpy()
                left = (bound <= factor * reach(known)[:, None] + 1e-7) | (known == -np.inf)[:, None]
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(left.sum(axis=1))).astype(np.int32), pa.array(np.broadcast_to(names, left.shape)[left]))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "cells"])

    waiting = asked.withColumnsRenamed({"cell": "own_cell", "part": "own_part"}).join(bar, "row")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in waiting.schema)
    routed = waiting.mapInArrow(route, f"{fields}, cells array<long>").withColumn("cell", F.explode("cells")).drop("cells").join(parts, ["dims", "cell"])
    routed = routed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    routed = routed.where("not (cell = own_cell and part = own_part)").select("dims", "cell", "part", "row", "vec_id", "v", "known")
    hits = near.unionByName(cut(_asked(routed, index, blocks, k, factor)))
    visited = hits.groupBy("row").agg(F.sum("seen").alias("visited"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "found")
    best = hits.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(visited, "row").select("query_id", "rank", "vec_id", "score", "visited")
