"""Gate classifiers and ratio regressors with Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.operators.routing import CLASSES, GATE_HIDDEN


def train_gate(
    workloads: DataFrame, label: str, dim: int, max_iter: int = 50, seed: int = 42
) -> MultilayerPerceptronClassificationModel:
    """Classifier of the best engine or lake of a workload from its pooled vector."""
    rows = workloads.select(array_to_vector("pooled").alias("features"), F.col(label).cast("double").alias("label"))
    net = MultilayerPerceptronClassifier(layers=[dim, *GATE_HIDDEN, CLASSES], maxIter=max_iter, seed=seed)
    return net.fit(rows)


def expert_features(config: Column, engine: Column, lake: Column, width: int, embedding: Column | None = None) -> Column:
    """Padded configuration, one-hot engine and lake, and the query's vector."""
    parts = [S.pad(config, width), S.one_hot(engine, CLASSES), S.one_hot(lake, CLASSES)]
    if embedding is not None:
        parts.append(embedding)
    return array_to_vector(F.concat(*parts))


def train_expert(records: DataFrame, features: Column, target: str = "ratio", weight: str | None = None,
                 max_iter: int = 10, max_depth: int = 4, seed: int = 42) -> GBTRegressionModel:
    """Regressor of the ratio to the best latency from sampled records."""
    columns = [features.alias("features"), F.col(target).cast("double").alias("label")]
    model = GBTRegressor(maxIter=max_iter, maxDepth=max_depth, seed=seed)
    if weight:
        columns.append(F.col(weight).cast("double").alias("weight"))
        model = model.setWeightCol("weight")
    return model.fit(records.select(*columns))
