"""Trial log: clean, normalise, pool, repair floor latencies, split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.functions.catalog import ENGINES, FLOOR_MS, LAKES
from lakewright.operators.skew import lookup, split_scan
from lakewright.session import materialize

QUERY = ["benchmark", "query_id"]
COMBO = ["engine_id", "lake_id"]
RECORD = [*QUERY, *COMBO]
_TEXT = ["engine", "datalake", "query_name", "conf", "sf", "latency"]


def accept(raw: DataFrame, floor: float = FLOOR_MS) -> DataFrame:
    """Trimmed rows with every name present and a numeric latency of at least ``floor``."""
    trimmed = raw.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in _TEXT})
    # Conditions on generated columns stay above them; on plain ones they would build every text again.
    row = F.struct(*[F.col(c) for c in trimmed.columns if c != "latency"], S.to_number(F.col("latency")).alias("latency"))
    valid = trimmed.select(F.explode_outer(F.array(row)).alias("_r")).select(*[f"_r.{c}" for c in trimmed.columns])
    for c in ("engine", "datalake", "query_name", "sf"):
        valid = valid.where(F.col(c) != "")
    return valid.where(F.col("latency") >= floor)


def with_combo_ids(trials: DataFrame) -> DataFrame:
    """Engine and lake names as ids; rows with an unknown name are dropped."""
    engines, lakes = S.literal_map(ENGINES), S.literal_map(LAKES)
    return (
        trials.withColumn("engine_id", F.try_element_at(engines, F.col("engine")))
        .withColumn("lake_id", F.try_element_at(lakes, F.col("datalake")))
        .where("engine_id IS NOT NULL AND lake_id IS NOT NULL")
    )


def normalise(raw: DataFrame) -> DataFrame:
    """Accepted trials with query id, combo ids and configuration vector."""
    trials = with_combo_ids(accept(raw))
    return trials.select(
        "benchmark",
        "file_name",
        "sf",
        S.query_id(F.col("query_name"), F.col("sf")).alias("query_id"),
        *COMBO,
        "conf",
        S.config_vector(F.col("conf"), F.col("engine_id"), F.col("lake_id")).alias("config"),
        "latency",
    )


def pool(logs: Sequence[DataFrame]) -> DataFrame:
    """Bag union of trial logs; ``benchmark`` keeps equal query ids of two benchmarks apart."""
    first, *rest = logs
    for log in rest:
        first = first.unionByName(log)
    return first


def without_benchmark(trials: DataFrame) -> DataFrame:
    """Compatibility view in which equal query ids of different benchmarks merge."""
    return trials.withColumn("benchmark", F.lit("all"))


def max_width(trials: DataFrame) -> DataFrame:
    return trials.agg(F.max(F.size("config")).alias("max_dim"))


def at_scale(trials: DataFrame, scale: str) -> DataFrame:
    return trials.where(F.startswith("query_id", F.lit(f"sf{scale}_")))


def rows_per_file(trials: DataFrame) -> DataFrame:
    return trials.groupBy("file_name").agg(F.count("*").alias("n_rows"))


def log_moments(trials: DataFrame, floor: float = FLOOR_MS) -> DataFrame:
    """Mean and spread of ln(latency + 1) that replace the floor rows of a (query, combo).

    A group without real latencies takes the moments of its combo over all queries. Those are
    merged from the group moments, so the log is scanned once.
    """
    value = F.when(F.col("latency") != floor, F.log(F.col("latency") + 1))
    groups = trials.groupBy(*RECORD).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mu"),
        F.stddev_pop(value).alias("sd"),
        F.count_if(F.col("latency") == floor).alias("n_floor"),
    )
    # Read twice below; written, so that the log behind it is read once.
    groups = materialize(groups)
    square = F.col("sd") * F.col("sd") + F.col("mu") * F.col("mu")
    combos = (
        groups.where("n > 0")
        .groupBy(*COMBO)
        .agg(
            (F.sum(F.col("n") * F.col("mu")) / F.sum("n")).alias("all_mu"),
            (F.sum(F.col("n") * square) / F.sum("n")).alias("all_square"),
        )
        .withColumn("all_sd", F.sqrt(F.greatest(F.col("all_square") - F.col("all_mu") ** 2, F.lit(0.0))))
    )
    # greatest() skips nulls, so a missing deviation must stay missing before the floor applies.
    floored = [F.when(F.col(c).isNotNull(), F.greatest(c, F.lit(0.1))) for c in ("sd", "all_sd")]
    sigma = F.coalesce(*floored, F.lit(0.5))
    # combos holds one row per engine and lake id: at most nine.
    return groups.join(F.broadcast(combos), COMBO, "left").select(
        *RECORD,
        "n",
        "n_floor",
        F.coalesce("mu", "all_mu", F.log(F.lit(10000.0))).alias("mu"),
        sigma.alias("sigma"),
    )


def repair(
    trials: DataFrame, seed: int = 42, floor: float = FLOOR_MS, stats_rows: DataFrame | None = None
) -> DataFrame:
    """Replace floor latencies by draws from the log-normal of their (query, combo).

    ``stats_rows`` limits the rows the moments come from, for instance to the training split.
    The draw depends on the row's content only, so it does not change with partitioning.
    """
    moments = log_moments(trials if stats_rows is None else stats_rows, floor)
    if stats_rows is None:
        moments = moments.where("n_floor > 0")
    joined = lookup(trials, moments.select(*RECORD, "mu", "sigma"), RECORD)
    mu = F.coalesce("mu", F.log(F.lit(10000.0)))
    sigma = F.coalesce("sigma", F.lit(0.5))
    draw = S.normal(F.lit(seed), *[F.col(c) for c in RECORD], F.col("conf"))
    imputed = F.greatest(F.lit(floor + 1), F.exp(mu + sigma * 0.5 * draw) - 1)
    at_floor = F.col("latency") == floor
    return (
        joined.withColumn("repaired", at_floor)
        .withColumn("latency", F.when(at_floor, imputed).otherwise(F.col("latency")))
        .drop("mu", "sigma")
    )


def query_ids(trials: DataFrame) -> DataFrame:
    return trials.select(*QUERY).distinct()


def dense_ids(queries: DataFrame) -> DataFrame:
    """0-based position of each query in sorted order."""
    return split_scan(queries, [], QUERY, out="q_idx")


def split_queries(
    queries: DataFrame, seed: int = 42, train: float = 0.70, valid: float = 0.15
) -> DataFrame:
    """Random split by query: order by a seeded hash, cut at the two truncated shares."""
    keyed = queries.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), *QUERY)))
    ranked = split_scan(keyed, [], ["_h", *QUERY], out="rank", total="n")
    n_train = F.floor(F.col("n") * F.lit(train))
    n_valid = F.floor(F.col("n") * F.lit(valid))
    part = (
        F.when(F.col("rank") < n_train, "train")
        .when(F.col("rank") < n_train + n_valid, "valid")
        .otherwise("test")
    )
    return ranked.select(*QUERY, part.alias("split"))


def summary(trials: DataFrame, split: DataFrame) -> DataFrame:
    """Query counts per split and the widest configuration, in one row."""
    counts = split.agg(
        F.count("*").alias("n_queries"),
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "valid", "test")],
    )
    return counts.crossJoin(max_width(trials))
