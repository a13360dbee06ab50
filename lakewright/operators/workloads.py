"""Best-per-query statistics, sampled workloads and training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.functions.catalog import RATIO_CAP, SAMPLE_LIMIT
from lakewright.operators.skew import lookup, split_scan
from lakewright.operators.trials import COMBO, QUERY, RECORD, dense_ids

# Ties in latency go to the lowest engine, lake and configuration text.
PICK = ["latency", *COMBO, "conf"]


def combo_stats(trials: DataFrame) -> DataFrame:
    """Per (query, combo): lowest latency, its configuration, number of records."""
    # Numbers only in the aggregate over the raw log, so that it hashes; texts are compared in its result.
    per_conf = trials.groupBy(*RECORD, "conf").agg(F.min("latency").alias("latency"), F.count("*").alias("n"))
    best = F.min(F.struct("latency", "conf"))
    rows = per_conf.groupBy(*RECORD).agg(best.alias("b"), F.sum("n").alias("n_records"))
    # The vector follows from the text, so only the text is carried through the aggregate.
    config = S.config_vector(F.col("b.conf"), F.col("engine_id"), F.col("lake_id"))
    return rows.select(
        *RECORD,
        F.col("b.latency").alias("best_lat"),
        F.col("b.conf").alias("best_conf"),
        config.alias("best_config"),
        "n_records",
    )


def query_best(stats: DataFrame) -> DataFrame:
    """Per query: the lowest latency over all combos and the record that reached it."""
    best = F.min(F.struct(F.col("best_lat").alias("latency"), *COMBO, F.col("best_conf").alias("conf"), F.col("best_config").alias("config")))
    return (
        stats.groupBy(*QUERY)
        .agg(best.alias("b"))
        .where("b.latency > 0")
        .select(
            *QUERY,
            F.col("b.latency").alias("query_best"),
            *[F.col(f"b.{c}").alias(f"best_{c}") for c in (*COMBO, "conf", "config")],
        )
    )


def combo_bit(engine: Column, lake: Column) -> Column:
    """One of nine bits per (engine, lake)."""
    return F.lit(1).cast("int") * F.pow(F.lit(2), engine * 3 + lake).cast("int")


def combo_masks(stats: DataFrame) -> DataFrame:
    """Per query: the combos it has records for, as a bit mask."""
    bit = combo_bit(F.col("engine_id"), F.col("lake_id"))
    return stats.groupBy(*QUERY).agg(F.bit_or(bit).alias("mask"))


def draw_queries(queries: DataFrame, attempts: int, min_q: int, max_q: int, seed: int) -> DataFrame:
    """Per attempt, a uniform size and that many distinct queries.

    Distinct positions are drawn one by one: draw ``t`` from 0..j for j = n-size .. n-1 and take
    ``j`` itself when ``t`` was taken before. No attempt meets the whole query list.
    """
    spark = queries.sparkSession
    indexed = dense_ids(queries)
    n = indexed.agg(F.count("*")).scalar()
    attempt = F.col("attempt")
    high = F.least(F.lit(max_q).cast("bigint"), F.col("n"))
    low = F.least(F.lit(min_q).cast("bigint"), F.col("n"))
    size = low + F.pmod(S.hash52(F.lit(seed), attempt, F.lit("size")), high - low + 1)

    def add(taken: Column, j: Column) -> Column:
        drawn = F.pmod(S.hash52(F.lit(seed), attempt, j), j + 1)
        return S.let(
            drawn,
            lambda t: F.concat(taken, F.array(F.when(F.array_contains(taken, t), j).otherwise(t))),
        )

    positions = F.aggregate(
        F.sequence(F.col("n") - F.col("size"), F.col("n") - 1), F.array().cast("array<bigint>"), add
    )
    drawn = (
        spark.range(1, attempts + 1)
        .select(F.col("id").alias("attempt"), n.alias("n"))
        .where("n > 0")
        .withColumn("size", size)
        .select("attempt", "size", F.explode_outer(positions).alias("q_idx"))
    )
    return drawn.join(indexed, "q_idx").select("attempt", "size", *QUERY)


def sample_workloads(
    queries: DataFrame,
    stats: DataFrame,
    wanted: int,
    min_q: int = 3,
    max_q: int = 15,
    min_combos: int = 3,
    seed: int = 42,
) -> DataFrame:
    """Member queries of the first ``wanted`` attempts that share enough combos.

    Up to 20 attempts per wanted workload. One row per (workload, query); ``mask`` holds the
    combos that every member query has.
    """
    masks = combo_masks(stats)
    drawn = draw_queries(queries.join(masks.select(*QUERY), QUERY, "left_semi"), wanted * 20, min_q, max_q, seed)
    members = drawn.join(masks, QUERY)
    # At most ``wanted`` rows, so broadcasting them is bounded by the parameter.
    kept = (
        members.groupBy("attempt")
        .agg(F.bit_and("mask").alias("common"))
        .where(F.bit_count("common") >= min_combos)
        .orderBy("attempt")
        .limit(wanted)
    )
    return members.drop("mask").join(F.broadcast(kept), "attempt").select(
        F.col("attempt").alias("workload_id"), *QUERY, F.col("common").alias("mask")
    )


def covered_combos(members: DataFrame, stats: DataFrame) -> DataFrame:
    """(workload, combo) pairs for which every member query has records, with summed best latency."""
    joined = members.join(stats.select(*RECORD, "best_lat"), QUERY)
    bit = combo_bit(F.col("engine_id"), F.col("lake_id"))
    return (
        joined.where(F.col("mask").bitwiseAND(bit) != 0)
        .groupBy("workload_id", *COMBO)
        .agg(F.sum("best_lat").alias("total_lat"))
    )


def workload_best(totals: DataFrame) -> DataFrame:
    best = F.min(F.struct("total_lat", *COMBO))
    return (
        totals.groupBy("workload_id")
        .agg(best.alias("b"))
        .select("workload_id", *[F.col(f"b.{c}").alias(c) for c in ("total_lat", *COMBO)])
    )


def workload_records(members: DataFrame, trials: DataFrame) -> DataFrame:
    """Every row of every member query, once per workload; callers reduce the trials per query first.

    ``members`` is bounded by workloads times queries per workload, both parameters, so it is
    broadcast and a hot query stays where it was read.
    """
    return trials.join(F.broadcast(members.select("workload_id", *QUERY)), QUERY)


def best_records(members: DataFrame, best: DataFrame) -> DataFrame:
    """Per workload and query: the record with the lowest latency, target ratio 1."""
    return members.select("workload_id", *QUERY).join(best, QUERY).withColumn("target", F.lit(1.0))


def with_ratio(trials: DataFrame, best: DataFrame, cap: float | None = RATIO_CAP) -> DataFrame:
    """``ratio`` = latency over the best latency of the query, optionally capped."""
    joined = lookup(trials, best.select(*QUERY, "query_best"), QUERY, "inner")
    ratio = F.when(F.col("query_best") > 0, F.col("latency") / F.col("query_best")).otherwise(F.lit(1.0))
    return joined.withColumn("ratio", ratio if cap is None else F.least(ratio, F.lit(cap)))


def quantile_sample(trials: DataFrame, limit: int = SAMPLE_LIMIT) -> DataFrame:
    """At most ``limit`` records per (query, combo), evenly spaced by latency rank.

    Equal records are counted first, ranks are computed over all tasks, and ``copies`` says how
    many of the chosen ranks fall on the record.
    """
    distinct = trials.groupBy(*RECORD, "conf", "latency").agg(F.count("*").alias("w"))
    ranked = split_scan(distinct, RECORD, ["latency", "conf"], F.col("w"), out="start", total="n")
    last = F.col("n") - 1
    step = F.greatest(F.lit(1), F.floor(F.col("n") / (limit - 1)))
    spots = F.array_distinct(
        F.concat(F.transform(F.sequence(F.lit(0), F.lit(limit - 2)), lambda i: F.least(i * step, last)), F.array(last))
    )
    inside = F.filter(spots, lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("w")))
    copies = F.when(F.col("n") <= limit, F.col("w")).otherwise(F.size(inside).cast("bigint"))
    kept = ranked.withColumn("copies", copies).where("copies > 0").drop("w", "start", "n")
    # The vector follows from the text, so it need not travel through the ranking.
    return kept.withColumn("config", S.config_vector(F.col("conf"), F.col("engine_id"), F.col("lake_id")))
