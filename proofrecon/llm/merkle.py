"""A Merkle manifest of a dataset: one tree per key (such as a language), and one tree over the keys' roots.

The forest is a monoid. A fragment is a set of nodes, each keyed by tree, the tree's size, level and index, so the
number of siblings in every run is known. Merging two fragments unites their nodes and replaces each complete run by
its parent, again and again; the order of merges doesn't matter. The root of a key's tree is a leaf of the top tree.

* Rows are range-sorted by (key, order) and cut into segments of ``SEGMENT`` neighbours. A segment merges to at most
  about two nodes a level.
* Tree reduction: neighbouring segments, then neighbouring partitions, ``FAN`` at a time, until one fragment is left:
  the root. Each round is a small written table; the driver sees the root only.
* The way back: from the top down each fragment hands its parts the nodes that lie beside their paths to the root, again
  about two a level; at last every leaf has its siblings at all levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofrecon.llm.common import cut, ranked

#: Leaves in a segment, bits of segments in a partition, and bits by which neighbouring partitions are merged in a round.
SEGMENT, INSIDE, FAN = 1 << 12, 21, 5
#: Tree, its size, level, index. Tree -1 is the one over the roots of the others.
Key = tuple[int, int, int, int]
_NODE = "tree long, size long, level int, index long, digest string"


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def run_of(key: Key, arity: int) -> tuple[Key, list[Key]]:
    """A node's parent and the run of siblings that the node is in; both empty of meaning for a root."""
    tree, size, level, index = key
    width = -(-size // arity**level)
    head = index // arity * arity
    return (tree, size, level + 1, index // arity), [(tree, size, level, k) for k in range(head, min(head + arity, width))]


def is_root(key: Key, arity: int) -> bool:
    return key[1] <= arity ** key[2]


def merge(nodes: Iterable[tuple[Key, str]], arity: int, trees: int) -> tuple[dict[Key, str], dict[Key, str]]:
    """The unresolved nodes that ``nodes`` merge to, and all nodes that are known by then."""
    known = dict(nodes)
    left, todo = dict(known), list(known)
    while todo:
        key = todo.pop()
        if key not in left:
            continue
        if is_root(key, arity):
            if key[0] < 0:
                continue
            parent, run = (-1, trees, 0, key[0]), [key]
            made = left[key]
        else:
            parent, run = run_of(key, arity)
            if not all(k in left for k in run):
                continue
            made = digest_of("".join(left[k] for k in run))
        for k in run:
            del left[k]
        known[parent] = left[parent] = made
        todo.append(parent)
    return left, known


def beside(key: Key, known: dict[Key, str], arity: int, trees: int, seen: set[Key]) -> dict[Key, str]:
    """The known nodes beside the path from ``key`` to the root, and the roots on it; stops where ``seen`` was met."""
    out = {}
    while key not in seen:
        seen.add(key)
        if is_root(key, arity):
            if key[0] < 0:
                break
            key = (-1, trees, 0, key[0])
            out[key] = known[key]
            continue
        parent, run = run_of(key, arity)
        out |= {k: known[k] for k in run if k != key and k in known}
        key = parent
    return out


def _nodes(table: pa.Table) -> list[tuple[Key, str]]:
    columns = [table.column(c).to_pylist() for c in ("tree", "size", "level", "index", "digest")]
    return [((t, s, v, i), d) for t, s, v, i, d in zip(*columns, strict=True)]


def _table(rows: list[tuple[int, Key, str]]) -> pa.Table:
    kinds = [("part", pa.int64()), ("tree", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())]
    flat = [(p, *key, d) for p, key, d in rows]
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(kinds)
    return pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], names=[name for name, _ in kinds])


def _merged_parts(fragments: DataFrame, shift: int, arity: int, trees: int) -> DataFrame:
    """Fragments (part, node) merged by ``part >> shift``, which becomes the part."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        left, _ = merge(_nodes(table), arity, trees)
        return _table([(key[0].as_py(), k, d) for k, d in left.items()])

    return fragments.withColumn("_to", F.shiftright("part", shift)).groupBy("_to").applyInArrow(run, f"part long, {_NODE}")


def _handed_down(parts: DataFrame, above: DataFrame, shift: int, arity: int, trees: int) -> DataFrame:
    """For each part the nodes beside its paths, from the parts' own nodes and what their parent (part >> shift) was handed."""

    def run(key: tuple, own: pa.Table, given: pa.Table) -> pa.Table:
        nodes = _nodes(own)
        _, known = merge(nodes, arity, trees)
        known |= dict(_nodes(given))
        members: dict[int, list[Key]] = {}
        for part, (k, _) in zip(own.column("part").to_pylist(), nodes, strict=True):
            members.setdefault(part, []).append(k)
        out = []
        for part, keys in members.items():
            seen: set[Key] = set()
            near: dict[Key, str] = {}
            for k in keys:
                near |= beside(k, known, arity, trees, seen)
            out += [(part, k, d) for k, d in near.items()]
        return _table(out)

    left = parts.withColumn("_to", F.shiftright("part", shift)).groupBy("_to")
    return left.cogroup(above.withColumn("_to", F.col("part")).groupBy("_to")).applyInArrow(run, f"part long, {_NODE}")


def _proofs(rows: DataFrame, near: DataFrame, arity: int, trees: int) -> DataFrame:
    """Each leaf row's siblings, level by level to the root: what precedes it in its run and what follows it, joined."""
    pair = pa.struct([("before", pa.string()), ("after", pa.string())])

    def run(key: tuple, own: pa.Table, given: pa.Table) -> pa.Table:
        nodes = _nodes(own)
        _, known = merge(nodes, arity, trees)
        known |= dict(_nodes(given))
        paths: dict[Key, list[tuple[str, str]]] = {}

        def path(k: Key) -> list[tuple[str, str]]:
            if k not in paths:
                if is_root(k, arity):
                    paths[k] = [] if k[0] < 0 else path((-1, trees, 0, k[0]))
                else:
                    parent, siblings = run_of(k, arity)
                    at = siblings.index(k)
                    step = ("".join(known[x] for x in siblings[:at]), "".join(known[x] for x in siblings[at + 1 :]))
                    paths[k] = [step, *path(parent)]
            return paths[k]

        lists = [path(k) for k, _ in nodes]
        offsets = [0]
        for x in lists:
            offsets.append(offsets[-1] + len(x))
        steps = pa.StructArray.from_arrays([pa.array([s[j] for x in lists for s in x], pa.string()) for j in (0, 1)], names=["before", "after"])
        proof = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps).cast(pa.list_(pair))
        subroot = pa.array([known[-1, trees, 0, k[0]] for k, _ in nodes], pa.string())
        return pa.table([own.column("_pos"), subroot, proof], names=["_pos", "subroot", "proof"])

    grouped = rows.select("part", "_pos", *_columns()).groupBy("part")
    return grouped.cogroup(near.groupBy("part")).applyInArrow(run, "_pos long, subroot string, proof array<struct<before string, after string>>")


def _columns() -> list[str]:
    return ["tree", "size", "level", "index", "digest"]


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields in turn, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def manifest(leaves: DataFrame, *, tree: str, order: str, arity: int = 2) -> DataFrame:
    """``leaves`` (column leaf, the key ``tree``, ``order`` and more) with subroot, root and proof.

    Leaves of one key ascend by ``order``; keys ascend, null first; rows without order come first, and rows of equal order
    by their leaf. Every ``arity`` consecutive nodes become their digest until one is left; a lone leaf is its own
    subroot. A key of any size, a third of all rows or one row, takes part alike. ``proof`` has for each level the
    siblings before and after, both empty where a node is alone in its run. An empty table gives no rows. Columns named
    like the results are replaced.
    """
    if tree in ("subroot", "root", "proof") or order in ("subroot", "root", "proof"):
        raise ValueError("the key and the order need other names")
    made = ("subroot", "root", "proof", "part", "size", "level", "index", "digest", "_pos", "_key")
    base = cut(leaves.drop(*(c for c in made if c not in (tree, order))))
    placed = cut(base.repartitionByRange(tree, order, "leaf").sortWithinPartitions(tree, order, "leaf").withColumn("_pos", F.monotonically_increasing_id()))
    cell = placed.select(F.col(tree).alias("_key"), "_pos", F.col("leaf").alias("digest"), F.shiftright("_pos", 33).alias("_part"))
    runs = cut(cell.groupBy("_key", "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_run")))
    sizes = runs.groupBy("_key").agg(F.sum("_run").alias("size")).withColumn("_all", F.lit(0)).withColumn("_null", F.col("_key").isNotNull())
    trees_of = cut(ranked(sizes, "_all", ["_null", "_key"]).select(F.col("_key").alias("_k"), "size", (F.col("rank") - 1).alias("tree")))
    trees, top = trees_of.count(), placed.agg(F.max("_pos")).first()[0]
    result = placed.select(*base.columns, "_pos")
    if top is None:
        return base.withColumns({"subroot": F.lit(""), "root": F.lit(""), "proof": F.array().cast("array<struct<before string, after string>>")})
    before = F.coalesce(F.sum("_run").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.withColumn("_base", before)
    starts = starts.join(trees_of, starts["_key"].eqNullSafe(trees_of["_k"])).select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), "_first", "_base", "size", "tree")
    starts = cut(starts)
    nodes = cell.join(starts, cell["_key"].eqNullSafe(starts["_k"]) & (cell["_part"] == starts["_p"]))
    inside = F.floor((F.col("_pos") - F.shiftleft(F.col("_part"), 33)) / SEGMENT).cast("long")
    nodes = nodes.select((F.shiftleft("_part", INSIDE) + inside).alias("part"), "_pos", "tree", "size", F.lit(0).alias("level"), (F.col("_pos") - F.col("_first") + F.col("_base")).alias("index"), "digest")
    nodes = cut(nodes)

    rounds, shift, last = [], INSIDE, (top >> 33) << INSIDE
    fragments = [cut(_merged_parts(nodes.drop("_pos"), 0, arity, trees))]
    while True:
        rounds.append(shift)
        fragments.append(cut(_merged_parts(fragments[-1], shift, arity, trees)))
        last >>= shift
        if not last:
            break
        shift = FAN
    root = [r["digest"] for r in fragments[-1].limit(2).collect()]
    if len(root) != 1:
        raise AssertionError("the forest has more than one root")
    near = fragments[-1].where("false")
    for shift, parts in zip(reversed(rounds), reversed(fragments[:-1]), strict=True):
        near = cut(_handed_down(parts, near, shift, arity, trees))
    proofs = _proofs(nodes, near, arity, trees)
    return result.join(proofs, "_pos").drop("_pos").withColumn("root", F.lit(root[0]))
