"""Ranking, running totals and lookups that never put one hot group into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.session import materialize

SALTS = 16
TASK_BYTES = 128 << 20
BROADCAST_BYTES = 64 << 20
UNPACKED = 4  # bytes of rows per byte of a written table
UNKNOWN_BYTES = 1 << 62
HOT_ROWS = 1000  # a key of fewer rows is never spread


def same(columns: Sequence[str]) -> Column:
    """Columns as one value in which nulls are equal, for joins."""
    return F.struct(F.lit(0).alias("_"), *[F.col(c) for c in columns])


def estimated_bytes(df: DataFrame) -> int:
    """Size of a frame as its plan estimates it from the files it reads.

    The plan takes a join for the product of its sides, so the estimate is held below the files' own bytes,
    unpacked. Leaves of unknown size do not count.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    read = sum(size for size in sizes if size < UNKNOWN_BYTES)
    return min(int(str(plan.stats().sizeInBytes())), UNPACKED * read)


def task_count(df: DataFrame) -> int:
    """Tasks for a shuffle of all rows: about ``TASK_BYTES`` each, the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(estimated_bytes(df) // TASK_BYTES, 1 << 20))


def split_scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    value: Column | None = None,
    how: str = "sum",
    out: str = "start",
    total: str | None = None,
) -> DataFrame:
    """Prefix sum or prefix minimum of ``value`` inside each group, split over many tasks.

    Rows are range-partitioned on (group, order), so a group of any size spreads over as many
    slabs as its rows need. Each slab is scanned on its own, and the few (slab, group) totals
    are scanned once more to give every slab its starting value.

    ``how="sum"`` gives the sum over strictly earlier rows (the 0-based rank when ``value`` is
    1), ``how="min"`` the minimum up to and including the row. ``total`` names an optional
    column with the value over the whole group. Rows equal in every key share one slab, so
    callers collapse copies into a weight first. Nulls in group columns are a group.
    """
    spark = df.sparkSession
    group = list(group)
    parts = task_count(df)
    fold = {"sum": F.sum, "min": F.min}[how]
    slabs = materialize(
        df.withColumn("_v", F.lit(1).cast("bigint") if value is None else value)
        .withColumn("_key", same(group))
        .repartitionByRange(parts, *group, *order)
        .withColumn("_slab", F.spark_partition_id())
    )
    here = Window.partitionBy("_slab", *group).orderBy(*order)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_slab")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    totals = (
        slabs.groupBy("_slab", "_key", *group)
        .agg(fold("_v").alias("_n"))
        .withColumn("_before", fold("_n").over(earlier))
        .withColumn("_all", fold("_n").over(whole))
        .select("_slab", "_key", "_before", "_all")
    )
    local = F.sum("_v").over(before) if how == "sum" else F.min("_v").over(upto)
    joined = slabs.withColumn("_local", local).join(totals, ["_slab", "_key"])
    if how == "sum":
        zero = F.lit(0)
        result = F.coalesce("_before", zero) + F.coalesce("_local", zero)
    else:
        result = F.when(F.col("_before") <= F.col("_local"), F.col("_before")).otherwise(F.col("_local"))
    joined = joined.withColumn(out, result)
    if total:
        joined = joined.withColumn(total, F.col("_all"))
    return joined.drop("_v", "_slab", "_key", "_local", "_before", "_all")


def in_memory_bytes(df: DataFrame) -> int:
    """Size of a table's rows, from its value count, text lengths and array lengths."""
    size = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            size = size + F.lit(16) + F.coalesce(F.length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            size = size + F.lit(16) + F.coalesce(F.size(field.name), F.lit(0)) * 64
        else:
            size = size + F.lit(16)
    return df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]


def lookup(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Attach one row per key of an aggregate to a large, possibly skewed table.

    The aggregate is written out once and measured. Up to ``limit_bytes`` it is broadcast, so
    the large side is not shuffled. Beyond that both sides are joined on (key, salt): the rows
    of a hot key spread over the salts and the aggregate is repeated per salt.
    """
    small = materialize(small)
    if in_memory_bytes(small) <= limit_bytes:
        return big.join(F.broadcast(small), list(keys), how)
    return salted_join(big, small, keys, how)


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that spreads each key of ``big`` over many tasks.

    There are as many salts as let a key with a third of all rows fill tasks of ``TASK_BYTES``,
    ``SALTS`` at least. The salt is the input partition number, which a retried task keeps. A small side that
    would outgrow the large one by its repeats is repeated for keys of many rows only.
    """
    salts = max(SALTS, min(estimated_bytes(big) // (3 * TASK_BYTES), 1 << 12))
    salt, repeats = F.pmod(F.spark_partition_id(), F.lit(salts)), F.sequence(F.lit(0), F.lit(salts - 1))
    if estimated_bytes(small) * salts > estimated_bytes(big):
        hot = hot_keys(big, keys).withColumn("_hot", F.lit(True))
        big, small = (side.join(F.broadcast(hot), list(keys), "left") for side in (big, small))
        # A missing key meets nothing, so its rows may lie anywhere.
        spread = F.col("_hot") | reduce(or_, [F.col(k).isNull() for k in keys])
        salt = F.when(spread, salt).otherwise(0)
        repeats = F.when(F.col("_hot"), repeats).otherwise(F.array(F.lit(0)))
    salted = big.withColumn("_salt", salt).drop("_hot")
    repeated = small.withColumn("_salt", F.explode(repeats)).drop("_hot")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def hot_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that hold more than a quarter of a task's share of all rows; four per task of a shuffle at most."""
    limit = max(rows.count() // (4 * task_count(rows)), HOT_ROWS)
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return materialize(counted.where(F.col("_n") > limit).select(*keys))
