"""Tree structure from pre-order depths, inside one row per plan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.operators.skew import split_scan
from lakewright.session import materialize

SWAP_SHARE = 0.3


def _lists(offsets: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Entries of all lists of a batch, and where each list begins; a missing list has none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _parents(depths: pa.Array) -> pa.Array:
    """Per node the nearest preceding node exactly one level shallower."""
    flat, begin = _flat(depths)
    levels, ends, out = flat.to_numpy(zero_copy_only=False).tolist(), begin.tolist(), []
    for a, b in zip(ends, ends[1:]):
        last: dict[int, int] = {}  # the last node seen at every level
        for i, d in enumerate(levels[a:b]):
            out.append(last.get(d - 1))
            last[d] = i
    return _lists(begin, pa.array(out, pa.int32()))


def _paths(parents: pa.Array) -> pa.Array:
    """Per node the ids from its root to itself."""
    flat, begin = _flat(parents)
    above, ends, sizes, out = flat.to_pylist(), begin.tolist(), [], []
    for a, b in zip(ends, ends[1:]):
        paths: list[list[int]] = []
        for i, p in enumerate(above[a:b]):
            paths.append([i] if p is None else [*paths[p], i])
            out += paths[-1]
            sizes.append(len(paths[-1]))
    nodes = _lists(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.array(out, pa.int32()))
    return _lists(begin, nodes)


def _children(parents: pa.Array) -> pa.Array:
    """Per node the ids of its children, ascending."""
    flat, begin = _flat(parents)
    above = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
    first = np.repeat(begin[:-1], np.diff(begin))  # of the node's plan
    child = np.flatnonzero(above >= 0)
    owner = above[child] + first[child]
    kids = (child - first[child])[np.argsort(owner, kind="stable")]
    counts = np.bincount(owner, minlength=len(above))
    return _lists(begin, _lists(np.concatenate([[0], np.cumsum(counts)]), pa.array(kids, pa.int32())))


def _of_children(kids: pa.Array) -> pa.Array:
    """Per node the first node that lists it as a child; the inverse of ``_children``."""
    lists, begin = _flat(kids)
    children, first = _flat(lists)
    sizes = np.diff(begin)
    owner = np.repeat(np.arange(len(lists)), np.diff(first))
    start = np.repeat(begin[:-1], sizes)
    at = start[owner] + children.to_numpy(zero_copy_only=False)
    parents = np.full(len(lists), -1, np.int64)
    parents[at[::-1]] = owner[::-1]
    missing = parents < 0
    return _lists(begin, pa.array(parents - start, pa.int32(), mask=missing))


def parents_of(children: str) -> Column:
    """Parent ids per node (null for a root), from the child ids."""
    return F.arrow_udf(_of_children, "array<int>")(children)


def with_paths(plans: DataFrame, depths: Column) -> DataFrame:
    """Add ``paths`` (root-to-node ids per node) and ``parents`` (null for a root).

    The parent of a node is the nearest preceding node exactly one level shallower.
    """
    # Generated, because Spark does not find a function in Arrow batches again whose argument has nested lambdas.
    plans = plans.withColumn("depths", F.explode_outer(F.array(depths)))
    plans = plans.withColumn("parents", F.arrow_udf(_parents, "array<int>")("depths"))
    return plans.withColumn("paths", F.arrow_udf(_paths, "array<array<int>>")("parents"))


def children(plan_parents: str = "parents") -> Column:
    """Child ids per node, in text order."""
    return F.arrow_udf(_children, "array<array<int>>")(plan_parents)


def parent_rows(plans: DataFrame) -> DataFrame:
    """(plan_key, node_id, parent_id, side, child_no): every node with a parent."""
    rows = plans.select("plan_key", "parents", F.posexplode_outer("parents").alias("node_id", "parent_id")).where(
        "parent_id IS NOT NULL"
    )
    child_no = F.size(F.filter(F.slice("parents", F.lit(1), F.col("node_id")), lambda p: p == F.col("parent_id")))
    side = F.when(child_no == 0, "left").when(child_no == 1, "right").otherwise("extra")
    return rows.select("plan_key", "node_id", "parent_id", side.alias("side"), child_no.alias("child_no"))


def ancestors(plans: DataFrame) -> DataFrame:
    """(plan_key, node_id, ancestor_id, hops): all proper ancestors of every node."""
    nodes = plans.select("plan_key", F.posexplode_outer("paths").alias("node_id", "path"))
    exploded = nodes.select("plan_key", "node_id", F.size("path").alias("n"), F.posexplode_outer("path").alias("k", "ancestor_id"))
    return exploded.where("k < n - 1").select(
        "plan_key", "node_id", "ancestor_id", (F.col("n") - 1 - F.col("k")).alias("hops")
    )


def adjacency(plans: DataFrame) -> DataFrame:
    """(plan_key, node_id, row): 0/1 row of the parent-to-child matrix."""
    ids = F.sequence(F.lit(0), F.size("parents") - 1)
    return plans.select("plan_key", "parents", F.explode_outer(ids).alias("node_id")).select(
        "plan_key",
        "node_id",
        F.transform("parents", lambda p: F.when(p == F.col("node_id"), 1).otherwise(0)).alias("row"),
    )


def _hops(parents: pa.Array, nodes: pa.Array) -> pa.Array:
    """Distances from a node of a plan to all its nodes; rows of plans of one size are computed together."""
    flat, begin = _flat(parents)
    above = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
    at, sizes = pc.fill_null(nodes, 0).to_numpy(zero_copy_only=False), np.diff(begin)
    out = np.empty(len(above), np.int32)
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        places = begin[rows][:, None] + np.arange(n)
        up, hops = above[places], np.full((len(rows), n), -1, np.int32)
        live, now, d = np.arange(len(rows)), at[rows], 0
        while len(live):  # the node and what is above it
            hops[live, now] = d
            now, d = up[live, now], d + 1
            live, now = live[now >= 0], now[now >= 0]
        for v in range(n):  # any other node is one further than its parent, which precedes it
            p = up[:, v]
            rest = np.flatnonzero((hops[:, v] < 0) & (p >= 0))
            near = hops[rest, p[rest]]
            hops[rest, v] = np.where(near >= 0, near + 1, -1)
        out[places] = hops
    return _lists(begin, pa.array(out, mask=out < 0))


def distances(plans: DataFrame) -> DataFrame:
    """(plan_key, node_id, hops): distance from a node to every node of its plan, null when
    nothing connects them."""
    nodes = plans.select("plan_key", "parents", F.posexplode_outer("parents").alias("node_id", "_parent"))
    return nodes.select("plan_key", "node_id", F.arrow_udf(_hops, "array<int>")("parents", "node_id").alias("hops"))


def roots(plans: DataFrame) -> DataFrame:
    rows = plans.select("plan_key", F.posexplode_outer("parents").alias("node_id", "parent_id"))
    return rows.where("parent_id IS NULL").select("plan_key", F.col("node_id").alias("root_id"))


def child_lists(plans: DataFrame) -> DataFrame:
    """(plan_key, node_id, children): flat tree."""
    return plans.select("plan_key", F.posexplode_outer(children()).alias("node_id", "children"))


def dummies(plans: DataFrame) -> DataFrame:
    """A dummy right child for every node that has a left child only."""
    return (
        child_lists(plans)
        .where(F.size("children") == 1)
        .select("plan_key", F.col("node_id").alias("parent_id"), F.lit("right").alias("side"), F.lit("Dummy").alias("operator"))
    )


def leaf_levels(plans: DataFrame) -> DataFrame:
    """(plan_key, node_id, level): 0 for leaves, one more than the highest child otherwise."""
    nodes = plans.select("plan_key", "paths", F.posexplode_outer("paths").alias("node_id", "path"))
    below = F.filter("paths", lambda p: F.array_contains(p, F.col("node_id")))
    deepest = F.array_max(F.transform(below, lambda p: F.size(p)))
    return nodes.select("plan_key", "node_id", (deepest - F.size("path")).alias("level"))


def heights(plans: DataFrame) -> DataFrame:
    """(plan_key, node_id, height): level of a node counted from 1."""
    return plans.select("plan_key", F.posexplode_outer("depths").alias("node_id", "depth")).select(
        "plan_key", "node_id", (F.col("depth") + 1).alias("height")
    )


def augment(plans: DataFrame, copies: int = 5, share: float = SWAP_SHARE, seed: int = 42) -> DataFrame:
    """``copies`` variants per plan in which two-child nodes swap sides with probability ``share``.

    The draw depends on plan, copy and node only. Copy 0 is the plan itself.
    """
    # Generated for the reason given in ``with_paths``.
    listed = plans.withColumn("parents", F.explode_outer(F.array("parents"))).withColumn("_kids", children())
    copied = listed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))

    def swap(kids: Column, i: Column) -> Column:
        draw = S.uniform(F.lit(seed), F.col("plan_key"), F.col("copy"), i)
        return F.when((F.size(kids) == 2) & (F.col("copy") > 0) & (draw < share), F.reverse(kids)).otherwise(kids)

    name = F.when(F.col("copy") == 0, F.col("plan_key")).otherwise(F.concat("plan_key", F.lit("_aug"), F.col("copy").cast("string")))
    return copied.withColumn("children", F.transform("_kids", swap)).withColumn("tree_key", name).drop("_kids")


def forest_offsets(sizes: DataFrame) -> DataFrame:
    """Running node offset of each plan in key order, over (plan_key, n_nodes).

    Sizes are written first: ranges are drawn from the rows before they are sent, which would parse every plan twice.
    """
    return split_scan(materialize(sizes), [], ["plan_key"], F.col("n_nodes").cast("bigint"), out="node_offset")
