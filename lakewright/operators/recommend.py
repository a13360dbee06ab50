"""Choose engine, lake format and configuration, and measure the choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.operators.skew import lookup
from lakewright.operators.trials import COMBO, QUERY, RECORD
from lakewright.operators.workloads import workload_records


def linear_score(config: Column, weights: list[float]) -> Column:
    """Deterministic scorer: product of the whole configuration with fixed weights, used in turn."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    terms = F.transform(config, lambda x, i: x * F.get(w, i % len(weights)))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def choose_combo(queries: DataFrame, engine_logits: Column, lake_logits: Column) -> DataFrame:
    return queries.select(
        *QUERY, S.argmax(engine_logits).alias("engine_star"), S.argmax(lake_logits).alias("lake_star")
    )


def candidates(trials: DataFrame, stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """Records of the chosen combo of their query; all records of a query without that combo."""
    match = (F.col("engine_id") == F.col("engine_star")) & (F.col("lake_id") == F.col("lake_star"))
    per_query = (
        stats.select(*RECORD)
        .join(chosen, QUERY)
        .groupBy(*QUERY, "engine_star", "lake_star")
        .agg(F.bool_or(match).alias("has_match"))
    )
    joined = lookup(trials, per_query, QUERY, "inner")
    return joined.where(match | ~F.col("has_match")).withColumn("fallback", ~F.col("has_match"))


def lowest_latencies(scored: DataFrame) -> DataFrame:
    return scored.groupBy(*RECORD, "conf", "pred").agg(F.min("latency").alias("latency"))


def pick_per_query(scored: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per query the record with the lowest prediction, among those of the chosen combo if any.

    Records are reduced to the lowest latency per configuration and prediction first, in a hash
    aggregate; both minima come from its result. Ties go to the lowest engine, lake, configuration
    and latency.
    """
    joined = lookup(lowest_latencies(scored), chosen, QUERY, "inner")
    match = (F.col("engine_id") == F.col("engine_star")) & (F.col("lake_id") == F.col("lake_star"))
    record = F.struct("pred", *COMBO, "conf", "latency")
    lowest = F.struct("latency", *COMBO, "conf")
    return (
        joined.groupBy(*QUERY)
        .agg(F.min(F.when(match, record)).alias("m"), F.min(record).alias("a"), F.min(lowest).alias("best"))
        .select(*QUERY, F.col("m").isNull().alias("fallback"), F.coalesce("m", "a").alias("p"), "best")
        .where("best.latency > 0")
        .select(
            *QUERY,
            "fallback",
            *[F.col(f"p.{c}").alias(f"pick_{c}") for c in (*COMBO, "conf", "latency")],
            *[F.col(f"best.{c}").alias(f"best_{c}") for c in COMBO],
            (F.col("p.latency") / F.col("best.latency")).alias("ratio"),
        )
    )


def pick_per_workload(members: DataFrame, scored: DataFrame) -> DataFrame:
    """Per workload one record over the pooled records of its queries; ratio to the pool minimum."""
    record = F.struct("pred", *COMBO, *QUERY, "conf", "latency")
    pooled = workload_records(members, lowest_latencies(scored))
    return (
        pooled.groupBy("workload_id")
        .agg(F.min(record).alias("p"), F.min("latency").alias("pool_best"))
        .where("pool_best > 0")
        .select(
            "workload_id",
            *[F.col(f"p.{c}").alias(f"pick_{c}") for c in (*COMBO, *QUERY, "conf", "latency")],
            (F.col("p.latency") / F.col("pool_best")).alias("ratio"),
        )
    )


def _accuracy(pick: str = "pick", best: str = "best") -> list[Column]:
    engine = F.col(f"{pick}_engine_id") == F.col(f"{best}_engine_id")
    lake = F.col(f"{pick}_lake_id") == F.col(f"{best}_lake_id")
    share = lambda test: F.avg(test.cast("int"))
    return [share(engine).alias("engine_acc"), share(lake).alias("lake_acc"), share(engine & lake).alias("combo_acc")]


def query_metrics(picks: DataFrame, members: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Mean ratio, accuracies, count and fallbacks, once per (workload, query) when members are given."""
    rows = picks if members is None else members.select("workload_id", *QUERY).join(picks, QUERY)
    return rows.groupBy(*(by or [])).agg(
        F.avg("ratio").alias("mean_ratio"),
        *_accuracy(),
        F.count("*").alias("n"),
        F.count_if("fallback").alias("n_fallback"),
    )


def workload_metrics(picks: DataFrame, best: DataFrame) -> DataFrame:
    """Mean ratio and accuracies of one pick per workload against the workload's best combo."""
    named = best.select("workload_id", *[F.col(c).alias(f"best_{c}") for c in COMBO])
    return picks.join(named, "workload_id").agg(F.avg("ratio").alias("mean_ratio"), *_accuracy(), F.count("*").alias("n"))


def gate_accuracy(choices: DataFrame, best: DataFrame) -> DataFrame:
    """Accuracy of the gates' choices per workload."""
    named = choices.select(
        "workload_id", F.col("engine_star").alias("pick_engine_id"), F.col("lake_star").alias("pick_lake_id")
    )
    targets = best.select("workload_id", *[F.col(c).alias(f"best_{c}") for c in COMBO])
    return named.join(targets, "workload_id").agg(*_accuracy(), F.count("*").alias("n"))


def gate_histogram(choices: DataFrame) -> DataFrame:
    """How often each gate predicts each id."""
    pairs = F.explode(
        F.array(
            F.struct(F.lit("engine").alias("gate"), F.col("engine_star").alias("id")),
            F.struct(F.lit("lake").alias("gate"), F.col("lake_star").alias("id")),
        )
    )
    return choices.select(pairs.alias("p")).groupBy("p.gate", "p.id").agg(F.count("*").alias("n"))
