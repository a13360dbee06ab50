"""Query embeddings to one vector per workload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.operators.skew import lookup

HEADS = 4


def _vector(column: str = "embedding") -> Column:
    return array_to_vector(F.col(column).cast("array<double>"))


def _summary(metrics: list[str], prefix: str, weight: Column | None = None) -> Column:
    """Element-wise statistics of a vector column, merged map-side; no row per dimension."""
    args = [_vector()] if weight is None else [_vector(), weight]
    return Summarizer.metrics(*metrics).summary(*args).alias(prefix)


def _population_std(variance: Column, n: Column) -> Column:
    """Sample variances to population deviations."""
    return F.transform(vector_to_array(variance), lambda v: F.sqrt(F.greatest(v, F.lit(0.0)) * (n - 1) / n))


def mean_max_std(members: DataFrame, key: str = "workload_id") -> DataFrame:
    """Per workload: mean, maximum and population deviation of its query vectors, concatenated."""
    stats = members.groupBy(key).agg(F.count("*").alias("n"), _summary(["mean", "max", "variance"], "s"))
    deviation = F.when(F.col("n") > 1, _population_std(F.col("s.variance"), F.col("n"))).otherwise(
        F.transform(vector_to_array("s.mean"), lambda _: F.lit(0.0))
    )
    return stats.select(
        key, "n", F.concat(vector_to_array("s.mean"), vector_to_array("s.max"), deviation).alias("pooled")
    )


def attention_pool(
    members: DataFrame, weights: Sequence[Sequence[float]], biases: Sequence[float], key: str = "workload_id"
) -> DataFrame:
    """Per workload: one softmax-weighted mean per head, then mean and maximum.

    The softmax over a workload's queries is a weighted mean with weights ``exp(score - top)``,
    so each head is one mergeable aggregate. Only the top scores are attached to the rows.
    """
    scores = [
        S.dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in w])) + F.lit(float(b)) for w, b in zip(weights, biases)
    ]
    heads = range(len(scores))
    scored = members.withColumns({f"_s{h}": scores[h] for h in heads})
    tops = scored.groupBy(key).agg(*[F.max(f"_s{h}").alias(f"_t{h}") for h in heads])
    joined = lookup(scored, tops, [key])
    parts = [_summary(["mean"], f"h{h}", F.exp(F.col(f"_s{h}") - F.col(f"_t{h}"))) for h in heads]
    pooled = joined.groupBy(key).agg(*parts, _summary(["mean", "max"], "raw"))
    vectors = [vector_to_array(f"h{h}.mean") for h in heads]
    return pooled.select(
        key, F.concat(*vectors, vector_to_array("raw.mean"), vector_to_array("raw.max")).alias("pooled")
    )


def spread(members: DataFrame, key: str = "batch_id") -> DataFrame:
    """Per batch: mean population variance per dimension and mean off-diagonal cosine.

    The pairwise cosines of unit vectors sum to the squared length of their sum, so no pair is
    formed: (|sum u|^2 - sum |u|^2) / (n (n - 1)).
    """
    norm = F.sqrt(S.dot(F.col("embedding"), F.col("embedding")))
    unit = S.let(norm, lambda n: F.transform("embedding", lambda x: x / (n + 1e-12)))
    rows = members.withColumn("_unit", unit).withColumn("_self", S.dot(F.col("_unit"), F.col("_unit")))
    stats = rows.groupBy(key).agg(
        F.count("*").alias("n"),
        F.sum("_self").alias("own"),
        _summary(["variance"], "s"),
        Summarizer.metrics("mean").summary(_vector("_unit")).alias("u"),
    )
    n = F.col("n")
    variance = F.transform(vector_to_array("s.variance"), lambda v: v * (n - 1) / n)
    mean_unit = vector_to_array("u.mean")
    cosine = (S.dot(mean_unit, mean_unit) * n * n - F.col("own")) / (n * (n - 1))
    return stats.where("n >= 2").select(
        key,
        "n",
        (S.array_sum(variance) / F.size(variance)).alias("variance"),
        cosine.alias("cosine"),
    ).withColumn("spread_loss", F.col("cosine") - F.col("variance"))


def seeded_heads(dim: int, heads: int = HEADS) -> tuple[list[list[float]], list[float]]:
    """Reproducible unit score vectors for untrained pools."""
    import numpy as np

    w = np.random.default_rng(42).normal(size=(heads, dim))
    return (w / np.linalg.norm(w, axis=1, keepdims=True)).tolist(), [0.0] * heads
