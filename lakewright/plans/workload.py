"""Queries over statistics, sampled workloads and training records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.operators import trials as T
from lakewright.operators import workloads as W
from lakewright.plans import sqltext as Q
from lakewright.plans.registry import query
from lakewright.plans.trial_log import repaired
from lakewright.session import materialize

_BASE = (Q.RAW, Q.ACCEPTED, Q.REPAIRED, Q.STATS)
_TRAIN = (*_BASE, Q.SPLIT, Q.workloads("train", 1000, 42))
_TEST = (*_BASE, Q.SPLIT, Q.workloads("test", 50, 8))


def sampled(spark, folder, part="train", wanted=1000, seed=42):
    """Repaired trials, their statistics and the sampled workloads of one split."""
    trials = materialize(repaired(spark, folder))
    stats = materialize(W.combo_stats(trials))
    queries = T.split_queries(stats.select(*T.QUERY).distinct()).where(F.col("split") == part)
    members = W.sample_workloads(queries.select(*T.QUERY), stats, wanted, seed=seed)
    return trials, stats, materialize(members)


@query(
    "a1_query_combo_stats",
    Q.with_(
        *_BASE,
        select=f"""SELECT {Q.REC}, round(best_lat, 4) AS best_lat, best_conf, {Q.fixed("best_config")} AS best_config, n_records
        FROM stats""",
    ),
)
def _(spark, folder):
    return W.combo_stats(repaired(spark, folder)).select(
        *T.RECORD,
        F.round("best_lat", 4).alias("best_lat"),
        "best_conf",
        S.fixed_point(F.col("best_config")).alias("best_config"),
        "n_records",
    )


@query(
    "a2_query_best",
    Q.with_(
        *_BASE,
        select="""SELECT benchmark, query_id, round(query_best, 4) AS query_best, best_engine_id, best_lake_id, best_conf
        FROM qbest WHERE query_best > 0""",
    ),
)
def _(spark, folder):
    return W.query_best(W.combo_stats(repaired(spark, folder))).select(
        *T.QUERY, F.round("query_best", 4).alias("query_best"), "best_engine_id", "best_lake_id", "best_conf"
    )


@query(
    "w4_sampled_workloads",
    Q.with_(*_TRAIN, select="SELECT workload_id, benchmark, query_id FROM members"),
)
def _(spark, folder):
    return sampled(spark, folder)[2].select("workload_id", *T.QUERY)


@query(
    "j3_workload_records",
    Q.with_(
        *_TRAIN,
        select="""SELECT workload_id, engine_id, lake_id, count(*) AS n_records, round(min(latency), 4) AS min_latency
        FROM members JOIN repaired USING (benchmark, query_id) GROUP BY ALL""",
    ),
)
def _(spark, folder):
    trials, _, members = sampled(spark, folder)
    reduced = trials.groupBy(*T.RECORD).agg(F.count("*").alias("n"), F.min("latency").alias("latency"))
    return (
        W.workload_records(members, reduced)
        .groupBy("workload_id", *T.COMBO)
        .agg(F.sum("n").alias("n_records"), F.round(F.min("latency"), 4).alias("min_latency"))
    )


@query(
    "j4_covering_combos",
    Q.with_(*_TRAIN, select="SELECT workload_id, engine_id, lake_id FROM covered"),
)
def _(spark, folder):
    _, stats, members = sampled(spark, folder)
    return W.covered_combos(members, stats).select("workload_id", *T.COMBO)


@query(
    "a3_combo_totals",
    Q.with_(*_TRAIN, select="SELECT workload_id, engine_id, lake_id, round(total_lat, 2) AS total_lat FROM totals"),
)
def _(spark, folder):
    _, stats, members = sampled(spark, folder)
    return W.covered_combos(members, stats).select("workload_id", *T.COMBO, F.round("total_lat", 2).alias("total_lat"))


@query(
    "w5_workload_best_combo",
    Q.with_(
        *_TRAIN,
        select="""SELECT workload_id, round(total_lat, 2) AS total_lat, engine_id, lake_id FROM
        (SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY total_lat, engine_id, lake_id) AS rn FROM totals)
        WHERE rn = 1""",
    ),
)
def _(spark, folder):
    _, stats, members = sampled(spark, folder)
    return W.workload_best(W.covered_combos(members, stats)).withColumn("total_lat", F.round("total_lat", 2))


@query(
    "w1_best_record_per_query",
    Q.with_(
        *_TRAIN,
        select=f"""SELECT workload_id, benchmark, query_id, best_engine_id, best_lake_id,
          {Q.fixed("best_config")} AS config, 1.0::double AS target
        FROM members JOIN qbest USING (benchmark, query_id)""",
    ),
)
def _(spark, folder):
    _, stats, members = sampled(spark, folder)
    return W.best_records(members, W.query_best(stats)).select(
        "workload_id",
        *T.QUERY,
        "best_engine_id",
        "best_lake_id",
        S.fixed_point(F.col("best_config")).alias("config"),
        "target",
    )


_QUANTILE = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {Q.REC} ORDER BY latency, conf) - 1 AS rn, count(*) OVER (PARTITION BY {Q.REC}) AS n
  FROM repaired),
sampled AS (
  SELECT * FROM ranked WHERE n <= 16 OR rn = 0 OR rn = n - 1
    OR (rn % greatest(1, n // 15) = 0 AND rn // greatest(1, n // 15) BETWEEN 1 AND 14))"""


@query(
    "w2_quantile_sample",
    Q.with_(
        *_BASE, _QUANTILE,
        select=f"SELECT {Q.REC}, conf, round(latency, 4) AS latency, count(*) AS copies FROM sampled GROUP BY ALL",
    ),
)
def _(spark, folder):
    return W.quantile_sample(repaired(spark, folder)).select(
        *T.RECORD, "conf", F.round("latency", 4).alias("latency"), "copies"
    )


@query(
    "t11_ratio_target",
    Q.with_(
        *_BASE,
        select=f"""SELECT {Q.REC}, conf, round(least(latency / query_best, 20.0), 4) AS ratio
        FROM repaired JOIN qbest USING (benchmark, query_id)""".replace("conf, round", "repaired.conf, round"),
    ),
)
def _(spark, folder):
    trials = materialize(repaired(spark, folder))
    best = W.query_best(W.combo_stats(trials))
    return W.with_ratio(trials, best).select(*T.RECORD, "conf", F.round("ratio", 4).alias("ratio"))


@query(
    "w2_expert_records",
    Q.with_(
        *_TEST, _QUANTILE,
        select="""SELECT workload_id, engine_id, lake_id, count(*) AS n_records,
          round(avg(least(latency / query_best, 20.0)), 4) AS mean_target
        FROM members JOIN sampled USING (benchmark, query_id) JOIN qbest USING (benchmark, query_id) GROUP BY ALL""",
    ),
)
def _(spark, folder):
    trials, stats, members = sampled(spark, folder, "test", 50, 8)
    records = W.with_ratio(W.quantile_sample(trials), W.query_best(stats))
    reduced = records.groupBy(*T.RECORD).agg(
        F.sum("copies").alias("copies"), F.sum(F.col("ratio") * F.col("copies")).alias("target")
    )
    return (
        W.workload_records(members, reduced)
        .groupBy("workload_id", *T.COMBO)
        .agg(F.sum("copies").alias("n_records"), F.round(F.sum("target") / F.sum("copies"), 4).alias("mean_target"))
    )


@query(
    "best_combo_and_ratio",
    Q.with_(
        *_BASE,
        select=f"""SELECT {Q.REC}, s.best_conf, round(best_lat, 4) AS best_lat, round(query_best, 4) AS query_best,
          round(least(best_lat / query_best, 20.0), 4) AS ratio
        FROM stats s JOIN qbest USING (benchmark, query_id)""",
    ),
)
def best_combo_and_ratio(spark, folder):
    stats = materialize(W.combo_stats(repaired(spark, folder)))
    best = W.query_best(stats).select(*T.QUERY, "query_best")
    joined = stats.join(best, T.QUERY)
    return joined.select(
        *T.RECORD,
        "best_conf",
        F.round("best_lat", 4).alias("best_lat"),
        F.round("query_best", 4).alias("query_best"),
        F.round(F.least(F.col("best_lat") / F.col("query_best"), F.lit(20.0)), 4).alias("ratio"),
    )
