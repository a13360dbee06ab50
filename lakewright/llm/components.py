"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.session import materialize


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
    return tuple(row)


def _pull_to_least(sides: DataFrame) -> DataFrame:
    """Link all neighbours of a node, and the node, to the least of them."""
    least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return sides.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the least node it is connected to.

    Each round writes its edges to the shared folder, so lineage stays short and a lost executor
    costs one round. Nodes are compared as they are; rows with a null end are ignored.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    stamp = _stamp(now)
    while stamp[0]:
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).union(now.select(F.col("v"), F.col("u")))
        large = _pull_to_least(both).where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.distinct().select(F.col("u").alias("a"), F.col("v").alias("b"))
        small = _pull_to_least(down)
        small = small.select(F.col("b").alias("u"), F.col("m").alias("v")).union(small.select("a", "m")).where("u <> v")
        now = materialize(small.distinct())
        before, stamp = stamp, _stamp(now)
        if stamp == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
