"""Mixing documents to target token shares of domains, with soft membership.

A classifier learned from a labelled table gives every document its posterior over the domains: one
FTRL-proximal logistic model per domain on hashed words, word pairs and text shape, normalised to a sum
of one. A document at rate r counts r * tokens * posterior expected tokens towards each domain. The
nonnegative rates are fitted by projected gradient on the squared distance of the domain totals from
their targets, starting from rate 1.

A step's gradient of a document depends on the totals only through one vector of the size of the domains,
so the steps are kept, not the rates: every pass computes each document's rate from its posterior and the
steps so far, and one aggregate gives the new totals. Nothing but totals reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.llm.linear import Weights, fit, margins, rows_of, shape_features, word_features
from lakewright.llm.textbatch import chunks, quoted, small_batches, words_of
from lakewright.llm.toxicity import labelled_sample
from lakewright.session import materialize

# The domains of the ``labels`` table, and the token shares that the registered query and the pipeline aim at.
TARGETS = {"good": 0.9, "junk": 0.08, "toxic": 0.02}


class DomainModel(NamedTuple):
    domains: list[str]
    at: list[np.ndarray]
    weight: list[np.ndarray]
    bias: np.ndarray


class Mixture(NamedTuple):
    domains: list[str]
    steps: list[list[float]]  # one vector over the domains per gradient step
    totals: list[float]  # expected tokens per domain under the fitted rates
    targets: list[float]


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id and the place of its domain in ``TARGETS``: toxic before junk (quality 0) before good."""
    place = F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).when(F.col("quality") <= 0, 1)
    return labels.select("doc_id", place.alias("domain"))


def _features(data: np.ndarray, offsets: np.ndarray):
    words = words_of(data, offsets)
    kinds = word_features(words)
    shape = shape_features(words, data, offsets)
    # The shape features stand at a place of their own after each text's words.
    first = words.first + np.arange(len(words.first)) * len(shape)
    ends = first[1:]
    joined = []
    for k, kind in enumerate(kinds):
        whole = np.full(first[-1], -1, np.int64)
        own = np.arange(len(kind)) + len(shape) * np.repeat(np.arange(len(ends)), np.diff(words.first))
        whole[own] = kind
        if k == 0:
            for j, line in enumerate(shape):
                whole[ends - len(shape) + j] = line
        joined.append(whole)
    return joined, first, np.diff(words.first)


def _fit(domains: int, epochs: int, min_texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, rows = [], []
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text")):
                kinds, first, _ = _features(data, offsets)
                rows += rows_of(kinds, first)
                labels += batch.column("label").slice(row, len(offsets) - 1).to_pylist()
        label = np.array(labels, np.int64)
        for k, model in enumerate(fit(rows, [label == k for k in range(domains)], epochs, min_texts)):
            at, weight, bias = model.sparse()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at) + 1, k)), pa.array(np.r_[at, -1]), pa.array(np.r_[weight, bias])],
                ["domain", "feature", "weight"],
            )

    return run


def train(
    docs: DataFrame,
    labelled: DataFrame,
    domains: list[str],
    rows: int = 8000,
    epochs: int = 5,
    min_texts: int = 1,
) -> DomainModel:
    """Fit on about ``rows`` documents of ``labelled`` (doc_id, place of the domain); one task holds them.

    Every feature of the sample learns; the L1 term decides which keep a weight.
    """
    sample = labelled_sample(docs, labelled, "domain", rows).repartition(1).sortWithinPartitions("doc_id")
    got = sample.select("label", "text").mapInArrow(
        _fit(len(domains), epochs, min_texts), "domain long, feature long, weight double"
    )
    got = got.toArrow()
    domain, feature, weight = (got[c].to_numpy() for c in ("domain", "feature", "weight"))
    mine = [(domain == k) & (feature >= 0) for k in range(len(domains))]
    bias = np.array([weight[(domain == k) & (feature < 0)].sum() for k in range(len(domains))])
    return DomainModel(domains, [feature[m] for m in mine], [weight[m] for m in mine], bias)


def _posteriors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: DomainModel = shared.value
        weights = Weights(list(zip(model.at, model.weight)))
        for batch in batches:
            for row, data, offsets in chunks(batch.column("_text")):
                kinds, first, tokens = _features(data, offsets)
                z = margins(weights, kinds, first) + model.bias
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                p /= p.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_row").slice(row, len(p)),
                        pa.array(tokens.astype(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.reshape(-1))
                        ),
                    ],
                    ["_row", "n_tokens", "posterior"],
                )

    return run


def posteriors(docs: DataFrame, model: DomainModel, columns: list[str] | None = None) -> DataFrame:
    """_row (the ``columns`` of each row, default all), n_tokens (words) and posterior of every row."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns if columns is None else columns
    row = F.struct(*[F.col(quoted(c)) for c in names])
    rows = docs.select(row.alias("_row"), F.col("text").alias("_text"))
    told = T.StructType().add("n_tokens", "long").add("posterior", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(_posteriors(shared), T.StructType([rows.schema["_row"], *told]))


def rate(steps: list[list[float]]) -> Column:
    """Rate of a document from its ``posterior`` after these steps; 1 for a document without words."""
    if not steps:
        return F.lit(1.0)
    told = F.array(*[F.array(*[F.lit(float(v)) for v in step]) for step in steps])

    def move(r: Column, step: Column) -> Column:
        pull = F.aggregate(F.zip_with("posterior", step, lambda p, y: p * y), F.lit(0.0), lambda a, b: a + b)
        return F.greatest(r - pull, F.lit(0.0))

    return F.when(F.col("n_tokens") > 0, F.aggregate(told, F.lit(1.0), move)).otherwise(F.lit(1.0))


def fit_rates(
    known: DataFrame,
    targets: dict[str, float],
    tokens: float | None = None,
    whole: str | None = None,
    tolerance: float = 1e-4,
    rounds: int = 60,
) -> Mixture:
    """Steps whose rates bring the expected tokens of the domains to their shares of ``tokens``.

    ``known`` has n_tokens and posterior; ``tokens`` is the wanted total (default: all there are, or as
    many more as the domain ``whole`` needs to reach its share without losing any of its own). Rates are measured against a document's tokens, and the totals against the inverse Gram matrix of the documents
    whose rate is not zero, so that a step arrives unless it brings more rates to zero. A step that makes the
    distance larger is taken back for one in the metric of all documents, which cannot. Stops when every total
    is within ``tolerance`` of the wanted total, or after ``rounds`` passes. No rows, or none with words, need
    no step.
    """
    domains = list(targets)
    share = np.array([targets[d] for d in domains], float)
    d = range(len(domains))
    p = [F.col("posterior")[k] for k in d]
    n = F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in d for j in d if i <= j]
    sums = known.agg(F.sum(n).alias("t"), *[F.sum(n * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    present = float(sums["t"] or 0.0)
    if present == 0:
        return Mixture(domains, [], [0.0] * len(domains), [0.0] * len(domains))
    def metric(row, prefix: str) -> np.ndarray:
        gram = np.zeros((len(domains), len(domains)))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = (row[f"{prefix}{i}_{j}"] or 0.0) / present
        return np.linalg.inv(gram + 1e-6 * max(np.trace(gram), 1e-12) * np.eye(len(domains)))

    own = known.agg(F.sum(n * p[domains.index(whole)])).first()[0] / targets[whole] * share.sum() if whole else 0.0
    goal = share / share.sum() * (max(present, own) if tokens is None else tokens) / present
    careful = metric(sums, "g")
    steps: list[list[float]] = []
    before = None  # the miss that the last step came from, if that step was a bold one
    for _ in range(rounds):
        r = rate(steps)
        alive = F.when(r > 0, n)
        row = known.agg(
            *[F.sum(n * p[k] * r).alias(f"s{k}") for k in d], *[F.sum(alive * p[i] * p[j]).alias(f"a{i}_{j}") for i, j in pairs]
        ).first()
        totals = np.array([row[f"s{k}"] for k in d])
        miss = totals / present - goal
        if before is not None and np.linalg.norm(miss) > np.linalg.norm(before):
            steps[-1] = (careful @ before).tolist()  # too bold: take the step that cannot overshoot
            before = None
            continue
        if np.abs(miss).max() <= tolerance * goal.sum():
            break
        steps.append((metric(row, "a") @ miss).tolist())
        before = miss
    else:
        totals = np.array(known.agg(*[F.sum(n * p[k] * rate(steps)) for k in d]).first())
    return Mixture(domains, steps, totals.tolist(), (goal * present).tolist())


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, p_<domain> and rate of every row.

    Null and empty texts have no tokens and rate 1. Equal texts get equal rates; rows come back as often
    as they are given.
    """
    model = train(docs, domain_labels(labels), list(targets))
    known = materialize(posteriors(docs, model, ["doc_id"]))
    mixture = fit_rates(known, targets)
    parts = [F.col("posterior")[k].alias(f"p_{name}") for k, name in enumerate(targets)]
    return known.select("_row.doc_id", "n_tokens", *parts, rate(mixture.steps).alias("rate"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, whole: str | None = "good") -> DataFrame:
    """The rows of ``docs`` with their columns, each as often as its rate says.

    A row at rate 1.3 comes once, and a second time with chance 0.3; the draw is a hash of doc_id and text,
    so a retried task repeats it and equal rows share it. Rows without words come once. ``whole`` names the
    domain that must not shrink; the wanted total grows for it.
    """
    model = train(docs, domain_labels(labels), list(targets))
    known = materialize(posteriors(docs, model, ["doc_id"]))
    mixture = fit_rates(known, targets, whole=whole)
    told = posteriors(docs, model).withColumn("_rate", rate(mixture.steps))
    draw = F.pmod(F.xxhash64("_row.doc_id", "_row.text", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(F.col("_rate")) + F.when(draw < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    rows = told.withColumn("_times", times.cast("int")).where("_times > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
