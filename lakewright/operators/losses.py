"""Training losses as aggregates over scored records.

Inputs carry ``batch_id``, ``workload_id``, logits and probabilities of both gates as arrays,
the predicted ratio, the target and the true engine and lake ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions import scalars as S

CLASSES = 3
LAMBDA_DIV = 0.1
LAMBDA_DIVERSITY = 1.0
LAMBDA_SPREAD = 2.0


def _label_prob(probs: str, label: str) -> Column:
    return F.element_at(F.col(probs), F.col(label).cast("int") + 1)


def _workload_mean(records: DataFrame, value: Column, name: str) -> DataFrame:
    """Mean over the records of a workload, then over the workloads of a batch."""
    per_workload = records.groupBy("batch_id", "workload_id").agg(F.avg(value).alias("_m"))
    return per_workload.groupBy("batch_id").agg(F.avg("_m").alias(name))


def weighted_mse(records: DataFrame) -> DataFrame:
    """Squared error weighted by the gate probabilities of the true engine and lake."""
    error = F.col("pred") - F.col("target")
    value = error * error * _label_prob("engine_probs", "engine_id") * _label_prob("lake_probs", "lake_id")
    return _workload_mean(records, value, "mse")


def cross_entropy(records: DataFrame) -> DataFrame:
    """Sum of both gates' negative log-likelihoods of the true class."""

    def nll(logits: str, label: str) -> Column:
        return S.log_sum_exp(F.col(logits)) - F.element_at(F.col(logits), F.col(label).cast("int") + 1)

    return _workload_mean(records, nll("engine_logits", "engine_id") + nll("lake_logits", "lake_id"), "ce")


def batch_probs(records: DataFrame) -> DataFrame:
    """Mean probability per gate and class over the records of a batch."""
    means = [
        F.avg(F.element_at(F.col(f"{gate}_probs"), c + 1)).alias(f"{gate}_{c}")
        for gate in ("engine", "lake")
        for c in range(CLASSES)
    ]
    return records.groupBy("batch_id").agg(*means)


def balance(means: DataFrame) -> DataFrame:
    """Squared distance of the batch-mean probabilities from uniform, both gates."""
    columns = [F.col(f"{g}_{c}") - 1.0 / CLASSES for g in ("engine", "lake") for c in range(CLASSES)]
    total = sum((x * x for x in columns[1:]), columns[0] * columns[0])
    return means.select("batch_id", total.alias("div"))


def entropy_gap(means: DataFrame) -> DataFrame:
    """Missing entropy of the batch-mean probabilities, per gate and summed."""

    def gap(gate: str) -> Column:
        terms = [F.col(f"{gate}_{c}") * F.log(F.col(f"{gate}_{c}") + 1e-12) for c in range(CLASSES)]
        return F.lit(math.log(CLASSES)) + terms[0] + terms[1] + terms[2]

    return means.select(
        "batch_id", gap("engine").alias("engine_gap"), gap("lake").alias("lake_gap")
    ).withColumn("diversity", F.col("engine_gap") + F.col("lake_gap"))


def total_loss(records: DataFrame, spread: DataFrame) -> DataFrame:
    """Weighted sum of all terms per batch; a batch of one workload has no spread term."""
    means = batch_probs(records)
    parts = weighted_mse(records).join(cross_entropy(records), "batch_id")
    parts = parts.join(balance(means), "batch_id").join(entropy_gap(means), "batch_id")
    parts = parts.join(spread.select("batch_id", "spread_loss"), "batch_id", "left")
    spread_loss = F.coalesce("spread_loss", F.lit(0.0))
    loss = (
        F.col("mse") + F.col("ce") + LAMBDA_DIV * F.col("div") + LAMBDA_DIVERSITY * F.col("diversity") + LAMBDA_SPREAD * spread_loss
    )
    return parts.select("batch_id", "mse", "ce", "div", "diversity", spread_loss.alias("spread_loss"), loss.alias("loss"))
