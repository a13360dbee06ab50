"""rank, dense_rank and percent_rank without sorting a whole partition in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.skew import lookup, same, split_scan


def with_rank(df: DataFrame, group: Sequence[str], value: str, kind: str, out: str, descending: bool = True) -> DataFrame:
    """Rows with their rank by ``value`` inside ``group``.

    The rank depends on the distinct values only: they are counted first, ranked over all tasks
    with equal values collapsed, and joined back. Null groups are a group and null values have a
    rank: last when descending, first when ascending.
    """
    order: Column = F.desc(value) if descending else F.asc(value)
    counts = df.groupBy(*group, value).agg(F.count("*").alias("_w"))
    weight = F.lit(1).cast("bigint") if kind == "dense_rank" else F.col("_w")
    ranked = split_scan(counts, group, [order], weight, out="_start", total="_n")
    result = {
        "rank": (F.col("_start") + 1).cast("bigint"),
        "dense_rank": (F.col("_start") + 1).cast("bigint"),
        "percent_rank": F.when(F.col("_n") > 1, F.col("_start") / (F.col("_n") - 1)).otherwise(F.lit(0.0)),
    }[kind]
    key = same([*group, value])
    ranks = ranked.select(key.alias("_key"), result.alias(out))
    names = [c for c in df.columns if c != out]
    return lookup(df.withColumn("_key", key), ranks, ["_key"], "inner").select(*names, out)


def not_in(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """``key NOT IN (SELECT right_key ...)`` with SQL null rules, as an equi-join.

    A null in the list rejects every row, a null key passes only an empty list.
    """
    values = right.select(F.col(right_key).alias(key))
    facts = values.agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls"))
    kept = left.join(values.where(F.col(key).isNotNull()), key, "left_anti")
    allowed = (F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(key).isNotNull())
    return (
        kept.withColumn("_n", facts.select("n").scalar())
        .withColumn("_nulls", facts.select("nulls").scalar())
        .where(allowed)
        .drop("_n", "_nulls")
    )
