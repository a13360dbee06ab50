"""Two-gate mixture scoring of configurations, evaluated in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.treeconv import Layer, mlp, seeded_layers

CLASSES = 3
CONF_DIM = 64
EXPERT_DIM = 128
GATE_HIDDEN = [128, 256]
EXPERT_HIDDEN = [128, 256, 256]
POST_HIDDEN = [128, 256, 256, 128, 64]
BLOCK = 1024  # records whose layers are computed together


@dataclass(frozen=True)
class Router:
    """Weights of the configuration encoder, both gates, the experts and the output network."""

    encoder: list[Layer]
    engine_gate: list[Layer]
    lake_gate: list[Layer]
    engine_experts: list[list[Layer]]
    lake_experts: list[list[Layer]]
    post: list[Layer]

    @classmethod
    def seeded(cls, emb_dim: int, conf_dim: int, seed: int = 42, width: int | None = None) -> Router:
        """Untrained weights; ``width`` makes every hidden layer and the experts' output that wide."""
        seeds = iter(range(seed, seed + 100))
        conf, out, gates, experts, post = CONF_DIM, EXPERT_DIM, GATE_HIDDEN, EXPERT_HIDDEN, POST_HIDDEN
        if width is not None:
            conf = out = width
            gates = experts = post = [width]
        gate = [emb_dim, *gates, CLASSES]
        expert = [emb_dim + conf + CLASSES, *experts, out]
        new = lambda sizes: seeded_layers(sizes, next(seeds), 1.0)
        return cls(
            new([conf_dim, conf, conf, conf] if width is None else [conf_dim, conf, conf]),
            new(gate),
            new(gate),
            [new(expert) for _ in range(CLASSES)],
            [new(expert) for _ in range(CLASSES)],
            new([2 * out, *post, 1]),
        )

    def gates(self, emb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return mlp(emb, self.engine_gate), mlp(emb, self.lake_gate)

    def soft(self, emb: np.ndarray, conf: np.ndarray) -> tuple[np.ndarray, ...]:
        """Predicted ratio with experts mixed by gate probabilities, and both logits."""
        engine_logits, lake_logits = self.gates(emb)
        pe, pl = _softmax(engine_logits), _softmax(lake_logits)
        return self._mixed(emb, conf, pe, pl), engine_logits, lake_logits

    def _mixed(self, emb: np.ndarray, conf: np.ndarray, pe: np.ndarray, pl: np.ndarray) -> np.ndarray:
        enc = mlp(conf, self.encoder)
        engine_in, lake_in = np.hstack([emb, enc, pl]), np.hstack([emb, enc, pe])
        engine = sum(pe[:, [k]] * mlp(engine_in, net) for k, net in enumerate(self.engine_experts))
        lake = sum(pl[:, [k]] * mlp(lake_in, net) for k, net in enumerate(self.lake_experts))
        return mlp(np.hstack([engine, lake]), self.post)[:, 0]

    def _pair(self, emb: np.ndarray, enc: np.ndarray, engine: int, lake: int) -> np.ndarray:
        eye = np.eye(CLASSES)
        n = len(emb)
        engine_vec = mlp(np.hstack([emb, enc, np.tile(eye[lake], (n, 1))]), self.engine_experts[engine])
        lake_vec = mlp(np.hstack([emb, enc, np.tile(eye[engine], (n, 1))]), self.lake_experts[lake])
        return mlp(np.hstack([engine_vec, lake_vec]), self.post)[:, 0]

    def hard(self, emb: np.ndarray, conf: np.ndarray, engine: int, lake: int) -> np.ndarray:
        """Predicted ratio through one expert pair."""
        return self._pair(emb, mlp(conf, self.encoder), engine, lake)

    def every(self, emb: np.ndarray, conf: np.ndarray) -> np.ndarray:
        """Predicted ratio through each expert pair, a column per pair in order of engine and lake."""
        out = np.empty((len(emb), CLASSES * CLASSES))
        for at in range(0, len(emb), BLOCK):
            rows = slice(at, at + BLOCK)
            enc = mlp(conf[rows], self.encoder)
            for pair in range(CLASSES * CLASSES):
                out[rows, pair] = self._pair(emb[rows], enc, *divmod(pair, CLASSES))
        return out

    def routed(self, emb: np.ndarray, conf: np.ndarray, engines: np.ndarray, lakes: np.ndarray) -> np.ndarray:
        """Predicted ratio through each record's own expert pair, one pass per pair present."""
        out = np.empty(len(emb))
        for engine, lake in set(zip(engines.tolist(), lakes.tolist())):
            rows = (engines == engine) & (lakes == lake)
            out[rows] = self.hard(emb[rows], conf[rows], engine, lake)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as a matrix, without an object per row."""
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(sizes) > 1 or None in sizes:
        raise ValueError(f"vectors of lengths {sizes}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if sizes else np.empty((0, 0))


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.ravel(), pa.float64()))


def score_routed(df: DataFrame, router: Router, emb: str, conf: str, engine: Column, lake: Column, out: str = "pred") -> DataFrame:
    """Add the predicted ratio of each record. ``engine`` and ``lake`` say which experts to use:
    the record's own ids, or the ids chosen by the gates."""
    shared = df.sparkSession.sparkContext.broadcast(router)

    def predict(e: pa.Array, c: pa.Array, engines: pa.Array, lakes: pa.Array) -> pa.Array:
        if len(e) == 0:
            return pa.array([], pa.float64())
        ids = (x.to_numpy(zero_copy_only=False) for x in (engines, lakes))
        return pa.array(shared.value.routed(_matrix(e), _matrix(c), *ids), pa.float64())

    return df.withColumn(out, F.arrow_udf(predict, "double")(F.col(emb), F.col(conf), engine, lake))


def score_every(df: DataFrame, router: Router, emb: str, conf: str, out: str = "preds") -> DataFrame:
    """Add the predicted ratios of each record through all expert pairs, in order of engine and lake."""
    shared = df.sparkSession.sparkContext.broadcast(router)

    def predict(e: pa.Array, c: pa.Array) -> pa.Array:
        return _lists(shared.value.every(_matrix(e), _matrix(c)))

    return df.withColumn(out, F.arrow_udf(predict, "array<double>")(F.col(emb), F.col(conf)))


def score_soft(df: DataFrame, router: Router, emb: str, conf: str, out: str = "scored") -> DataFrame:
    """Add a struct with the predicted ratio and the logits of both gates."""
    shared = df.sparkSession.sparkContext.broadcast(router)

    def predict(e: pa.Array, c: pa.Array) -> pa.Array:
        if len(e) == 0:
            parts = [np.empty(0), np.empty((0, CLASSES)), np.empty((0, CLASSES))]
        else:
            parts = shared.value.soft(_matrix(e), _matrix(c))
        columns = [pa.array(parts[0], pa.float64()), _lists(parts[1]), _lists(parts[2])]
        return pa.StructArray.from_arrays(columns, ["pred", "engine_logits", "lake_logits"])

    schema = "pred double, engine_logits array<double>, lake_logits array<double>"
    return df.withColumn(out, F.arrow_udf(predict, schema)(F.col(emb), F.col(conf)))


def encode_config(df: DataFrame, router: Router, conf: str, out: str = "encoded") -> DataFrame:
    """Add the dense representation of a configuration."""
    shared = df.sparkSession.sparkContext.broadcast(router.encoder)

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for c in batches:
            yield pd.Series(list(mlp(np.stack(c.to_numpy()), shared.value))) if len(c) else pd.Series([], dtype=object)

    return df.withColumn(out, encode(F.col(conf)))


def gate_choice(df: DataFrame, router: Router, emb: str) -> DataFrame:
    """Add ``engine_logits`` and ``lake_logits`` of an embedding."""
    shared = df.sparkSession.sparkContext.broadcast((router.engine_gate, router.lake_gate))

    @F.pandas_udf("engine_logits array<double>, lake_logits array<double>")
    def gates(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for e in batches:
            if len(e) == 0:
                yield pd.DataFrame({"engine_logits": [], "lake_logits": []})
            else:
                x = np.stack(e.to_numpy())
                engine_gate, lake_gate = shared.value
                yield pd.DataFrame({"engine_logits": list(mlp(x, engine_gate)), "lake_logits": list(mlp(x, lake_gate))})

    return df.withColumn("_g", gates(F.col(emb))).select("*", "_g.engine_logits", "_g.lake_logits").drop("_g")
