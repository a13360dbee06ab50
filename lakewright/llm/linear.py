"""Hashed text features and FTRL-proximal logistic regression on them."""

from __future__ import annotations

import numpy as np

from lakewright.llm.textbatch import IS_WORD, Words, mix

DIM_BITS = 20
DIM = 1 << DIM_BITS


def word_features(words: Words, skips: int = 1) -> list[np.ndarray]:
    """Feature of each word, of each word pair, and of each pair with 1 to ``skips`` words between.

    Aligned with the words; -1 where the pair would leave its text.
    """
    h, n = words.hash, len(words.hash)
    shift = np.uint64(64 - DIM_BITS)
    out = [(mix(h) >> shift).astype(np.int64)]
    ends = np.repeat(words.first[1:], np.diff(words.first))
    for gap in range(1, skips + 2):
        pair = np.full(n, -1, np.int64)
        if n > gap:
            both = mix(h[:-gap] * np.uint64(3) + h[gap:] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(gap))
            pair[:-gap] = (both >> shift).astype(np.int64)
        pair[np.arange(n) + gap >= ends] = -1
        out.append(pair)
    return out


def shape_features(words: Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Four features per text: tenths of capitals, of signs, of digits and of distinct words."""
    size = np.maximum(np.diff(offsets), 1)
    filled = np.diff(offsets) > 0
    kinds = [(data >= 65) & (data <= 90), ~IS_WORD[data] & (data != 32), (data >= 48) & (data <= 57)]
    shares = np.zeros((4, len(size)))
    for k, kind in enumerate(kinds):
        if filled.any():
            shares[k, filled] = np.add.reduceat(kind.astype(np.int64), offsets[:-1][filled]) / size[filled]
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        shares[3, i] = len(np.unique(words.hash[a:b])) / max(1, b - a)
    tenth = np.minimum((shares * 10).astype(np.int64), 9)
    code = (np.arange(4)[:, None] * 10 + tenth + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mix(code) >> np.uint64(64 - DIM_BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal: per-coordinate rates, L1 for sparsity, L2 for stability."""

    def __init__(self, alpha: float = 1.5, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIM), np.zeros(DIM)
        self.bias_z = self.bias_n = 0.0

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z, rate = self.z[at], (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One step on a row with distinct features ``at`` and values ``x``."""
        w, b = self._weights(at), self.bias()
        error = 1 / (1 + np.exp(-np.clip(b + w @ x, -35, 35))) - label
        g = error * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        sigma = ((self.bias_n + error**2) ** 0.5 - self.bias_n**0.5) / self.alpha
        self.bias_z += error - sigma * b
        self.bias_n += error**2

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Indexes and values of the weights that are not zero, and the bias."""
        w = self._weights(np.arange(DIM))
        at = np.flatnonzero(w)
        return at, w[at], self.bias()


def value(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts)


def rows_of(features: list[np.ndarray], first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and values of each text."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        found = np.concatenate([f[a:b] for f in features])
        at, counts = np.unique(found[found >= 0], return_counts=True)
        out.append((at.astype(np.int32), value(counts).astype(np.float32)))
    return out


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: list[np.ndarray], epochs: int, min_texts: int, l1: float = 6.0
) -> list[Ftrl]:
    """One model per label vector, on the features that at least ``min_texts`` of the rows have.

    The order of the steps is a seeded shuffle.
    """
    held = np.bincount(np.concatenate([np.zeros(0, np.int32), *(at for at, _ in rows)]), minlength=DIM) >= min_texts
    rows = [(at[held[at]], x[held[at]]) for at, x in rows]
    models = [Ftrl(l1=l1) for _ in labels]
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)).tolist():
            for model, label in zip(models, labels):
                model.learn(*rows[i], int(label[i]))
    return models


class Weights:
    """The weights that are not zero, of several models over the same features."""

    def __init__(self, models: list[tuple[np.ndarray, np.ndarray]]):
        self.at = np.unique(np.concatenate([np.zeros(0, np.int64), *(at for at, _ in models)]))
        self.values = np.zeros((len(models), len(self.at)))
        for k, (at, weight) in enumerate(models):
            self.values[k, np.searchsorted(self.at, at)] = weight
        self.used = np.zeros(DIM + 1, bool)  # the last place answers for no feature
        self.used[self.at] = True


def margins(weights: Weights, features: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Weighted sums (texts x models), bias left out."""
    texts = len(first) - 1
    of = np.repeat(np.arange(texts), np.diff(first))
    keys = [(of[hit] << DIM_BITS) | f[hit] for f in features for hit in [weights.used[f]]]
    pairs, counts = np.unique(np.concatenate(keys), return_counts=True)
    place = np.searchsorted(weights.at, pairs & (DIM - 1))
    out = np.zeros((texts, len(weights.values)))
    for k, w in enumerate(weights.values):
        out[:, k] = np.bincount(pairs >> DIM_BITS, w[place] * value(counts), texts)
    return out
