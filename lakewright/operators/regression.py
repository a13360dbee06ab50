"""Ridge regressions of many groups at once, from summed products.

A task adds up, for each group it meets, the products of its rows' inputs with each other and with the
targets. The sums of all tasks are added in two steps and solved per group, so the rows of a group may be in
any number of tasks and no task needs all of them. Sums are added in the order of the tasks, so a repeated
run gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = 32  # sums of tasks added together in the first step


def _products(keys: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        targets = 0
        for batch in batches:
            for key, rows in batch.groupby(list(keys), dropna=False, sort=False):
                x, y = np.stack(rows["x"].to_numpy()), np.stack(rows["y"].to_numpy())
                w, targets = rows["w"].to_numpy(float)[:, None], y.shape[1]
                both = np.hstack([x, y])
                total = np.concatenate([[w.sum()], ((both * w).T @ both).ravel()])
                held[key] = held[key] + total if key in held else total
        part = TaskContext.get().partitionId()
        names = dict(zip(keys, zip(*held))) if held else {k: [] for k in keys}
        sums = [s.tolist() for s in held.values()]
        yield pd.DataFrame({**names, "part": [part] * len(held), "targets": [targets] * len(held), "sums": sums})

    return run


def _add(rows: pd.DataFrame) -> np.ndarray:
    return np.sum(np.stack(rows.sort_values("part")["sums"].to_numpy()), axis=0)


def _solve(total: np.ndarray, targets: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients per target and the mean squared error on the rows themselves."""
    n = total[0]
    size = int(round(np.sqrt(len(total) - 1)))
    products = total[1:].reshape(size, size)
    inputs = size - targets
    xx, xy, yy = products[:inputs, :inputs], products[:inputs, inputs:], np.diag(products)[inputs:]
    ridge = penalty * np.eye(inputs)
    ridge[0, 0] = 0.0  # the first input is the constant
    beta = np.linalg.lstsq(xx + ridge, xy, rcond=None)[0]
    error = (yy - 2 * (beta * xy).sum(0) + (beta * (xx @ beta)).sum(0)) / n if n > 0 else np.zeros(targets)
    return beta.T, np.maximum(error, 0.0)


def fit_ridge(
    rows: DataFrame, keys: Sequence[str], inputs: Column, targets: Column, weight: Column | None = None, penalty: float = 1.0
) -> DataFrame:
    """(keys, n, coefficients, mse): one model per group; ``coefficients`` has one list per target.

    ``inputs`` and ``targets`` are arrays of one length each; the first input is the constant 1, which is not
    penalised. Rows with a null array take no part, a group without rows has no model.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    used = rows.select(*keys, inputs.alias("x"), targets.alias("y"), w.alias("w")).where("x IS NOT NULL AND y IS NOT NULL")
    kept = [used.schema[k] for k in keys]
    parts = used.mapInPandas(_products(keys), T.StructType([*kept, T.StructField("part", T.IntegerType()), T.StructField("targets", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))]))
    group = [F.col(k) for k in keys]

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.sort_values("part").iloc[[0]]
        return first.assign(sums=[_add(rows).tolist()])[[*keys, "part", "targets", "sums"]]

    parts = parts.groupBy(*group, F.floor(F.col("part") / STEP).alias("_step")).applyInPandas(merge, parts.schema)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        total = _add(rows)
        beta, error = _solve(total, int(rows["targets"].iloc[0]), penalty)
        return rows.iloc[[0]][[*keys]].assign(n=total[0], coefficients=[beta.tolist()], mse=[error.tolist()])

    schema = T.StructType([*kept, T.StructField("n", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("mse", T.ArrayType(T.DoubleType()))])
    return parts.groupBy(*group).applyInPandas(solve, schema)


def dot(x: Column, coefficients: Column) -> Column:
    """Prediction of one target."""
    return F.aggregate(F.zip_with(x, coefficients, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def sketch(df: DataFrame, vector: str, dim: int, out: str, seed: int = 42) -> DataFrame:
    """Add ``out``: ``vector`` on ``dim`` seeded random directions, which keep distances roughly."""

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        directions = None
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series([], dtype=object)
                continue
            x = np.stack(batch.to_numpy())
            if directions is None:
                directions = np.random.default_rng(seed).standard_normal((x.shape[1], dim)) / np.sqrt(x.shape[1])
            yield pd.Series(list(x @ directions))

    return df.withColumn(out, project(F.col(vector)))
