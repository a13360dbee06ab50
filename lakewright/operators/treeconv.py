"""Tree convolution over plan vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.operators.trees import _flat

KERNELS = 4
EPS = 1e-5
BLOCK = 1024  # rows of a layer at a time, so that its numbers stay in a core's cache
TREES = 1024  # trees of a forest


@dataclass(frozen=True)
class Layer:
    """One linear layer; every layer but the last is followed by normalisation and ReLU."""

    weight: np.ndarray
    bias: np.ndarray


def _normal(x: np.ndarray, eps: float) -> np.ndarray:
    """Normalisation and ReLU of the rows of ``x``, in place."""
    x -= x.mean(axis=-1, keepdims=True)
    x /= np.sqrt(np.einsum("...i,...i->...", x, x)[..., None] / x.shape[-1] + eps)
    return np.maximum(x, 0.0, out=x)


def mlp(x: np.ndarray, layers: Sequence[Layer], eps: float = EPS) -> np.ndarray:
    for i, layer in enumerate(layers):
        x = x @ layer.weight + layer.bias
        if i < len(layers) - 1:
            x = _normal(x, eps)
    return x


def seeded_layers(sizes: Sequence[int], seed: int = 42, gain: float = 2.0) -> list[Layer]:
    """Uniform Xavier weights with zero biases."""
    rng = np.random.default_rng(seed)
    layers = []
    for fan_in, fan_out in zip(sizes, sizes[1:]):
        bound = gain * np.sqrt(6.0 / (fan_in + fan_out))
        layers.append(Layer(rng.uniform(-bound, bound, (fan_in, fan_out)), np.zeros(fan_out)))
    return layers


def binary(kids: Sequence[Sequence[int]]) -> tuple[list[list[int]], np.ndarray]:
    """Children of a forest with at most two each, and the level of every node above its leaves.

    A node with more children keeps its first and gets a dummy node for the others, which does the
    same; dummies are numbered after all nodes. Children have larger ids than their parent.
    """
    n = len(kids)
    pairs = [list(k) for k in kids]
    level = [0] * n
    for node in range(n - 1, -1, -1):
        while len(pairs[node]) > 2:
            rest = pairs[node][-2:]
            pairs[node][-2:] = [len(pairs)]
            pairs.append(rest)
            level.append(1 + max(level[k] for k in rest))
        level[node] = max((level[k] + 1 for k in pairs[node]), default=0)
    return pairs, np.array(level, dtype=int)


def _sliced(own: np.ndarray, left: np.ndarray, right: np.ndarray | None, layers: Sequence[Layer], kernels: int) -> np.ndarray:
    """Slice k of the layers' output on a node's vector and its children's slices k, for every kernel k.

    ``left`` and ``right`` have one slice for all kernels, or one per kernel; a missing ``right`` is a zero vector. The
    first layer multiplies each part on its own, so the node's is multiplied once, and the last computes slice k only.
    """
    (n, width), (first, *others) = own.shape, layers

    def part(x: np.ndarray, start: int) -> np.ndarray:
        return (x.reshape(-1, width) @ first.weight[start : start + width]).reshape(n, x.shape[1], -1)

    x = part(own[:, None, :], 0) + first.bias + part(left, width)
    if right is not None:
        x = x + part(right, 2 * width)
    slices = x.shape[1]
    x = x.reshape(n * slices, -1)
    if not others:
        x = np.broadcast_to(x.reshape(n, slices, -1), (n, kernels, x.shape[1]))
        return np.stack([x[:, k, k * width : (k + 1) * width] for k in range(kernels)], axis=1)
    for layer in others[:-1]:
        x = _normal(x, EPS) @ layer.weight + layer.bias
    x, last = _normal(x, EPS), others[-1]
    if slices == 1:
        return (x @ last.weight + last.bias).reshape(n, kernels, width)
    x, out = x.reshape(n, slices, -1), np.empty((n, kernels, width))
    for k in range(kernels):
        here = slice(k * width, (k + 1) * width)
        out[:, k] = x[:, k] @ last.weight[:, here] + last.bias[here]
    return out


def convolve(features: np.ndarray, kids: Sequence[Sequence[int]], layers: Sequence[Layer], kernels: int) -> np.ndarray:
    """Embedding of every node of a forest, children before parents, one step per level.

    A leaf repeats its own vector per kernel. An inner node runs the layers on its vector and
    its two children's slices of kernel k and keeps output slice k. Third and later children come
    in through dummy nodes with a zero vector. A leaf's slices are one, so what only leaves enter is computed once.
    """
    given, width = features.shape
    kids, level = binary(kids)
    n = len(kids)
    features = np.concatenate([features, np.zeros((n - given, width))])
    out = np.empty((n, kernels, width))
    leaves = level == 0
    out[leaves] = features[leaves, None, :]
    left = np.array([k[0] if k else -1 for k in kids], dtype=int)
    right = np.array([k[1] if len(k) > 1 else -1 for k in kids], dtype=int)
    # Kind of the children: a leaf or not on the left; none, a leaf or another node on the right.
    kind = 3 * leaves[left] + np.where(right < 0, 0, 1 + leaves[right])
    order = np.lexsort((kind, level))
    order = order[leaves.sum() :]
    cuts = np.flatnonzero((np.diff(level[order]) != 0) | (np.diff(kind[order]) != 0)) + 1
    for group in np.split(order, cuts) if len(order) else []:
        leaf, other = divmod(int(kind[group[0]]), 3)
        shared = leaf and other != 1
        step = BLOCK if shared else max(BLOCK // kernels, 1)
        for start in range(0, len(group), step):
            nodes = group[start : start + step]
            a = features[left[nodes]][:, None, :] if leaf else out[left[nodes]]
            b = None if other == 0 else features[right[nodes]][:, None, :] if other == 2 else out[right[nodes]]
            out[nodes] = _sliced(features[nodes], a, b, layers, kernels)
    return out[:given].reshape(given, kernels * width)


def _forest(values: np.ndarray, begin: Sequence[int], kids: Sequence[Sequence[Sequence[int]]]):
    """Rows of ``values``, children and roots of the forest of some trees, children after their parents.

    Trees in a row that have the same vectors, as the variants of one plan, share the nodes with the same children.
    """
    rows: list[int] = []
    pairs: list[list[int]] = []
    roots = []
    known: dict[tuple[int, ...], int] = {}
    for t, children in enumerate(kids):
        a, b = begin[t], begin[t + 1]
        if not (t and b - a == a - begin[t - 1] and np.array_equal(values[a:b], values[begin[t - 1] : a])):
            known.clear()
            base = a
        place = [0] * (b - a)
        for i in range(b - a - 1, -1, -1):
            own = [place[c] for c in children[i]]
            key = (i, *own)
            at = known.get(key)
            if at is None:
                at = known[key] = len(rows)
                rows.append(base + i)
                pairs.append(own)
            place[i] = at
        roots.append(place[0])
    last = len(rows) - 1
    return rows[::-1], [[last - c for c in own] for own in reversed(pairs)], [last - r for r in roots]


def plan_embeddings(trees: DataFrame, layers: Sequence[Layer], kernels: int = KERNELS) -> DataFrame:
    """(plan_key, embedding) from (plan_key, features, children): the root row of each plan.

    A plan is one row, so nothing is shuffled; the trees of an Arrow batch are convolved as forests.
    """
    weights = trees.sparkSession.sparkContext.broadcast(list(layers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TREES):
                keys, features, children = batch.slice(start, TREES).columns
                nodes, begin = _flat(features)
                values, first = _flat(nodes)
                widths = set(np.diff(first).tolist())
                if len(widths) > 1:
                    raise ValueError(f"vectors of {sorted(widths)} entries in one forest")
                values = values.to_numpy(zero_copy_only=False).reshape(len(nodes), -1)
                lists, each = _flat(children)
                flat, ends = _flat(lists)
                flat, ends = flat.to_numpy(zero_copy_only=False).tolist(), ends.tolist()
                kids = [flat[i:j] for i, j in zip(ends, ends[1:])]
                each = each.tolist()
                rows, pairs, roots = _forest(values, begin.tolist(), [kids[i:j] for i, j in zip(each, each[1:])])
                found = convolve(values[rows], pairs, weights.value, kernels)[roots]
                offsets = pa.array(np.arange(len(roots) + 1) * found.shape[1], pa.int32())
                vectors = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([keys, vectors], ["plan_key", "embedding"])

    return trees.select("plan_key", "features", "children").mapInArrow(run, "plan_key string, embedding array<double>")


def needed_trees(trees: DataFrame, mapping: DataFrame) -> DataFrame:
    """Only the plans some query maps to."""
    return trees.join(mapping.where(F.col("plan_key").isNotNull()).select("plan_key").distinct(), "plan_key", "left_semi")
