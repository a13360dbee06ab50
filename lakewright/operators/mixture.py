"""Training of the two-gate mixture by gradients that all tasks add up.

A pass sends the weights out, every task returns one gradient of the mixture's size for its rows, and the
gradients are added in two steps in the order of the tasks; the driver holds the weights and one step of
Adam. No task needs more than a batch of rows, and a repeated task returns the same gradient.

Rows are of two kinds. ``kind`` 1 is the best run of a query: its soft-routed prediction, weighted by the gate
probabilities of its engine and lake, should be its target, the gates should choose them, and the gates'
mean probabilities should be spread. ``kind`` 3 is any sampled run, routed to its own experts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.operators.losses import LAMBDA_DIV, LAMBDA_DIVERSITY
from lakewright.operators.routing import CLASSES, Router
from lakewright.operators.treeconv import Layer

STEP = 32  # gradients of tasks added together in the first step
CLIP = 1.0
_EYE = np.eye(CLASSES)
_EPS = 1e-5


def forward(x: np.ndarray, net: list[Layer]) -> tuple[np.ndarray, list]:
    """Output of a network and what its gradient needs."""
    kept = []
    for i, layer in enumerate(net):
        z = x @ layer.weight + layer.bias
        if i == len(net) - 1:
            kept.append((x, None, None))
            return z, kept
        sd = np.sqrt(z.var(axis=1, keepdims=True) + _EPS)
        n = (z - z.mean(axis=1, keepdims=True)) / sd
        kept.append((x, n, sd))
        x = np.maximum(n, 0.0)
    return x, kept


def backward(g: np.ndarray, net: list[Layer], kept: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Gradient with respect to the input, and of each weight and bias."""
    grads: list[np.ndarray] = []
    for layer, (x, n, sd) in zip(reversed(net), reversed(kept)):
        if n is not None:
            g = g * (n > 0)
            g = (g - g.mean(axis=1, keepdims=True) - n * (g * n).mean(axis=1, keepdims=True)) / sd
        grads = [x.T @ g, g.sum(axis=0), *grads]
        g = g @ layer.weight.T
    return g, grads


def networks(router: Router) -> list[list[Layer]]:
    return [router.encoder, router.engine_gate, router.lake_gate, *router.engine_experts, *router.lake_experts, router.post]


def to_vector(router: Router) -> np.ndarray:
    return np.concatenate([p.ravel() for net in networks(router) for layer in net for p in (layer.weight, layer.bias)])


def from_vector(vector: np.ndarray, like: Router) -> Router:
    at, nets = 0, []
    for net in networks(like):
        layers = []
        for layer in net:
            w, b = layer.weight, layer.bias
            weight = vector[at : at + w.size].reshape(w.shape)
            layers.append(Layer(weight, vector[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        nets.append(layers)
    encoder, engine, lake, *experts, post = nets
    return Router(encoder, engine, lake, experts[:CLASSES], experts[CLASSES:], post)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Gradient:
    """Gradient and loss sums of one batch after another."""

    def __init__(self, router: Router, means: np.ndarray, n1: float, n3: float):
        self.router, self.means, self.n1, self.n3 = router, means, max(n1, 1e-12), max(n3, 1e-12)
        self.nets = networks(router)
        self.grads = [[np.zeros_like(p) for layer in net for p in (layer.weight, layer.bias)] for net in self.nets]
        # squared error and cross-entropy of kind 1, squared error of kind 3, probabilities of both gates
        self.sums = np.zeros(3 + 2 * CLASSES)

    def _back(self, g: np.ndarray, which: int, kept: list) -> np.ndarray:
        g, grads = backward(g, self.nets[which], kept)
        for total, part in zip(self.grads[which], grads):
            total += part
        return g

    def best_runs(self, emb, conf, engine, lake, target, weight) -> None:
        r, w = self.router, weight[:, None]
        enc, k_enc = forward(conf, r.encoder)
        logits, kept = zip(*(forward(emb, gate) for gate in (r.engine_gate, r.lake_gate)))
        p = [_softmax(x) for x in logits]
        size = emb.shape[1] + enc.shape[1]
        outs, k_outs, mixed = [], [], []
        for side, experts in enumerate((r.engine_experts, r.lake_experts)):
            given = np.hstack([emb, enc, p[1 - side]])
            o, k = zip(*(forward(given, net) for net in experts))
            outs.append(o)
            k_outs.append(k)
            mixed.append(sum(p[side][:, [c]] * o[c] for c in range(CLASSES)))
        pred, k_post = forward(np.hstack(mixed), r.post)
        error = pred[:, 0] - target
        rows = np.arange(len(emb))
        chosen = [p[0][rows, engine], p[1][rows, lake]]
        self.sums[0] += (weight * error**2 * chosen[0] * chosen[1]).sum()
        self.sums[1] -= (weight * (np.log(chosen[0] + 1e-300) + np.log(chosen[1] + 1e-300))).sum()
        self.sums[3:] += np.concatenate([(w * x).sum(axis=0) for x in p])
        g_p = [np.zeros_like(x) for x in p]
        scale = weight / self.n1
        for side, label in enumerate((engine, lake)):
            g_p[side][rows, label] += scale * error**2 * chosen[1 - side]
            m = self.means[side * CLASSES : (side + 1) * CLASSES]
            g_p[side] += scale[:, None] * (2 * LAMBDA_DIV * (m - 1 / CLASSES) + LAMBDA_DIVERSITY * (np.log(m + 1e-12) + 1))
        g = self._back((scale * 2 * error * chosen[0] * chosen[1])[:, None], len(self.nets) - 1, k_post)
        half = mixed[0].shape[1]
        g_enc = np.zeros_like(enc)
        for side, g_mixed in enumerate((g[:, :half], g[:, half:])):
            for c in range(CLASSES):
                g_p[side][:, c] += (g_mixed * outs[side][c]).sum(axis=1)
                g_in = self._back(p[side][:, [c]] * g_mixed, 3 + side * CLASSES + c, k_outs[side][c])
                g_enc += g_in[:, emb.shape[1] : size]
                g_p[1 - side] += g_in[:, size:]
        for side, label in enumerate((engine, lake)):
            inner = (g_p[side] * p[side]).sum(axis=1, keepdims=True)
            self._back(p[side] * (g_p[side] - inner) + scale[:, None] * (p[side] - _EYE[label]), 1 + side, kept[side])
        self._back(g_enc, 0, k_enc)

    def sampled_runs(self, emb, conf, engine, lake, target, weight) -> None:
        r = self.router
        for e, k in sorted(set(zip(engine.tolist(), lake.tolist()))):
            rows = (engine == e) & (lake == k)
            x, n = emb[rows], int(rows.sum())
            enc, k_enc = forward(conf[rows], r.encoder)
            size = x.shape[1] + enc.shape[1]
            a, k_a = forward(np.hstack([x, enc, np.tile(_EYE[k], (n, 1))]), r.engine_experts[e])
            b, k_b = forward(np.hstack([x, enc, np.tile(_EYE[e], (n, 1))]), r.lake_experts[k])
            pred, k_post = forward(np.hstack([a, b]), r.post)
            error, w = pred[:, 0] - target[rows], weight[rows]
            self.sums[2] += (w * error**2).sum()
            g = self._back((w * 2 * error / self.n3)[:, None], len(self.nets) - 1, k_post)
            g_a = self._back(g[:, : a.shape[1]], 3 + e, k_a)
            g_b = self._back(g[:, a.shape[1] :], 3 + CLASSES + k, k_b)
            self._back(g_a[:, x.shape[1] : size] + g_b[:, x.shape[1] : size], 0, k_enc)

    def add(self, batch: pd.DataFrame) -> None:
        for kind, step in ((1, self.best_runs), (3, self.sampled_runs)):
            part = batch[batch["kind"] == kind]
            if len(part):
                emb, conf = (np.stack(part[c].to_numpy()) for c in ("emb", "conf"))
                ids = (part[c].to_numpy(int) for c in ("engine_id", "lake_id"))
                step(emb, conf, *ids, part["target"].to_numpy(float), part["weight"].to_numpy(float))

    def vector(self) -> np.ndarray:
        return np.concatenate([self.sums, *[g.ravel() for net in self.grads for g in net]])


def _total(rows: pd.DataFrame) -> np.ndarray:
    return np.sum(np.stack(rows.sort_values("part")["sums"].to_numpy()), axis=0)


def gradient_sums(rows: DataFrame, router: Router, means: np.ndarray, n1: float, n3: float) -> np.ndarray:
    """Loss sums and the gradient over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((router, means, n1, n3))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = Gradient(*shared.value)
        for batch in batches:
            total.add(batch)
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [total.vector().tolist()]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [rows["part"].min()], "sums": [_total(rows).tolist()]})

    parts = rows.mapInPandas(run, "part int, sums array<double>")
    merged = parts.groupBy(F.floor(F.col("part") / STEP)).applyInPandas(merge, "part int, sums array<double>")
    out = _total(merged.toPandas())  # a row per STEP tasks, each of the mixture's size
    shared.unpersist()
    return out


@dataclass
class Epoch:
    """Losses of an epoch's last pass and the ratio on the validation queries after it."""

    epoch: int
    s1: float
    mse: float
    ce: float
    div: float
    diversity: float
    s3: float
    valid_ratio: float


def train(
    rows: DataFrame,
    start: Router,
    validate: Callable[[Router], float],
    epochs: int = 6,
    passes: int = 5,
    rate: float = 0.02,
) -> tuple[Router, list[Epoch]]:
    """The mixture of the epoch with the lowest validation ratio, and every epoch's losses.

    ``rows`` (emb, conf, engine_id, lake_id, target, weight, kind) are read once per pass. The spread terms use
    the mean probabilities of the pass before. Ties go to the earlier epoch.
    """
    weights = {k: w for k, w in rows.groupBy("kind").agg(F.sum("weight")).collect()}
    n1, n3 = float(weights.get(1) or 0.0), float(weights.get(3) or 0.0)
    vector, means = to_vector(start), np.full(2 * CLASSES, 1 / CLASSES)
    first, second = np.zeros_like(vector), np.zeros_like(vector)
    history: list[Epoch] = []
    best = (float("inf"), start)
    step = 0
    for epoch in range(1, epochs + 1):
        for _ in range(passes):
            step += 1
            out = gradient_sums(rows, from_vector(vector, start), means, n1, n3)
            sums, g = out[: 3 + 2 * CLASSES], out[3 + 2 * CLASSES :]
            means = sums[3:] / max(n1, 1e-12) if n1 else means
            g = g * min(1.0, CLIP / max(float(np.linalg.norm(g)), 1e-12))
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            vector = vector - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        mse, ce, s3 = sums[0] / max(n1, 1e-12), sums[1] / max(n1, 1e-12), sums[2] / max(n3, 1e-12)
        div = float(((means - 1 / CLASSES) ** 2).sum())
        diversity = float(2 * np.log(CLASSES) + (means * np.log(means + 1e-12)).sum())
        router = from_vector(vector, start)
        ratio = float(validate(router))
        total = float(mse + ce + LAMBDA_DIV * div + LAMBDA_DIVERSITY * diversity)
        history.append(Epoch(epoch, total, float(mse), float(ce), div, diversity, float(s3), ratio))
        if ratio < best[0]:
            best = (ratio, router)
    return best[1], history
