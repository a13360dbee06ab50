"""Query names to plan keys, and embeddings with a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.operators.regression import dot, fit_ridge
from lakewright.operators.routing import CLASSES
from lakewright.operators.trials import QUERY

_SCALED = r"^sf\d+_(.+)$"


def candidate_keys(query_id: Column) -> Column:
    """Plan keys a query may have, in order of preference."""
    base = F.when(query_id.rlike(_SCALED), F.regexp_extract(query_id, _SCALED, 1)).otherwise(query_id)

    def given(test: Column, *keys: Column) -> Column:
        return F.when(test, F.array(*keys)).otherwise(F.array().cast("array<string>"))

    def number(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(base, pattern, group)

    spelled = F.concat(F.lit("tpcds_q"), F.replace(F.substr(base, F.lit(6)), F.lit("_"), F.lit("")))
    bare = F.regexp_replace(base, r"tpcds_q_0*(\d+)", "tpcds_q$1")
    ssb = r"^q(\d+)_(\d+)$"
    return F.concat(
        given(F.startswith(base, F.lit("query")), spelled),
        given(F.startswith(base, F.lit("tpcds_q")), base, bare),
        given(base.rlike(r"^db\d+$"), F.concat(F.lit("tpch_1_db"), number(r"^db(\d+)$")), F.concat(F.lit("tpch_0_q"), number(r"^db(\d+)$"))),
        given(
            base.rlike(ssb),
            F.concat(F.lit("ssb_Q"), number(ssb, 1), F.lit("."), number(ssb, 2)),
            F.concat(F.lit("ssb_q"), number(ssb, 1), number(ssb, 2)),
        ),
        given(F.startswith(base, F.lit("ssb_")), base),
        given(F.startswith(base, F.lit("job_")), base),
        given(base.rlike(r"^q\d+$"), F.concat(F.lit("tpch_0_q"), number(r"^q(\d+)$")), F.concat(F.lit("tpcds_q"), number(r"^q(\d+)$"))),
        given(F.contains(base, F.lit("gpt")), base),
    )


def map_queries(queries: DataFrame, plan_keys: DataFrame) -> DataFrame:
    """(benchmark, query_id, plan_key): first candidate that exists, null when none does."""
    keys = plan_keys.where(~F.contains("plan_key", F.lit("_aug"))).select("plan_key").distinct()
    candidates = queries.select(*QUERY, F.posexplode_outer(candidate_keys(F.col("query_id"))).alias("choice", "plan_key"))
    found = (
        candidates.join(keys, "plan_key")
        .groupBy(*QUERY)
        .agg(F.min(F.struct("choice", "plan_key")).alias("f"))
        .select(*QUERY, "f.plan_key")
    )
    return queries.select(*QUERY).join(found, QUERY, "left")


def latency_profiles(stats: DataFrame) -> DataFrame:
    """(benchmark, query_id, profile): 1, then the query's log of the best latency on each combo, centred.

    A combo the query was never run on has the mean over the queries, 0 after centring. The means are nine
    numbers, whatever the log's size.
    """
    cells = [(e, k) for e in range(CLASSES) for k in range(CLASSES)]

    def best(e: int, k: int) -> Column:
        return F.min(F.when((F.col("engine_id") == e) & (F.col("lake_id") == k), F.log("best_lat")))

    wide = stats.groupBy(*QUERY).agg(*[best(e, k).alias(f"c{e}{k}") for e, k in cells])
    means = wide.agg(*[F.avg(f"c{e}{k}") for e, k in cells]).first()
    centred = [F.coalesce(F.col(f"c{e}{k}") - F.lit(m), F.lit(0.0)) for (e, k), m in zip(cells, means)]
    return wide.select(*QUERY, F.array(F.lit(1.0), *centred).alias("profile"))


def fallback_vectors(profiles: DataFrame, known: DataFrame, penalty: float = 1.0) -> DataFrame:
    """(benchmark, query_id, own_embedding) of the queries without a plan, estimated from their trials.

    Ridge least squares from latency profiles to the embeddings of the queries with a plan; the model has ten
    rows of an embedding's length, solved from summed products.
    """
    both = profiles.join(known.select(*QUERY, "embedding"), QUERY).withColumn("all", F.lit(0))
    model = fit_ridge(both, ["all"], F.col("profile"), F.col("embedding"), penalty=penalty).select("coefficients")
    missing = profiles.join(known.select(*QUERY), QUERY, "left_anti")
    # One row, as large as ten embeddings.
    return missing.crossJoin(F.broadcast(model)).select(
        *QUERY, F.transform("coefficients", lambda row: dot(F.col("profile"), row)).alias("own_embedding")
    )


def with_fallback(queries: DataFrame, plan_embeddings: DataFrame, own: DataFrame) -> DataFrame:
    """Per query: the embedding of its plan, else its own row; normalised per vector.

    Queries without a plan key join under a key of their own, so they do not meet in one task.
    """
    alone = F.concat(F.lit("\0"), F.col("benchmark"), F.lit("\0"), F.col("query_id"))
    keyed = queries.withColumn("_k", F.coalesce("plan_key", alone))
    joined = keyed.join(plan_embeddings.withColumnRenamed("plan_key", "_k"), "_k", "left").join(own, QUERY, "left")
    return joined.select(
        *QUERY,
        F.col("embedding").isNull().alias("is_fallback"),
        S.layer_norm(F.coalesce("embedding", "own_embedding")).alias("embedding"),
    )
