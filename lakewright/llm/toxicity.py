"""Toxicity scores: FTRL-proximal logistic regression over hashed words, word pairs and skip pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.langid import held_out
from lakewright.llm.linear import DIM, Weights, fit, margins, rows_of, word_features
from lakewright.llm.textbatch import chunks, small_batches, words_of
from lakewright.operators.skew import lookup
from lakewright.session import materialize


class ToxicityModel(NamedTuple):
    at: np.ndarray
    weight: np.ndarray
    bias: float


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(label, text) of about ``rows`` labelled documents that are not held out, drawn by a hash of the id.

    Null labels and ids are left out; of repeated labels of a document the largest counts, and of
    documents that share an id one is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    size = known.count()
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < (1 << 20) * rows / max(size, 1))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return lookup(texts, known, ["doc_id"], "inner").dropDuplicates(["doc_id"]).select("doc_id", "label", "text")


def _caps(counts: dict[str, int], room: int) -> dict[str, float]:
    """Share to draw of each stratum: small ones whole, the others alike, about ``room`` rows in all."""
    share, left = {}, len(counts)
    for key, n in sorted(counts.items(), key=lambda c: (c[1], c[0])):
        take = min(n, room / left)
        share[key], room, left = take / max(n, 1), room - take, left - 1
    return share


def toxic_first_sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, float]:
    """(label, text) of about ``rows`` labelled documents that are not held out, and the log of how much likelier a toxic one is drawn.

    All toxic documents come first, up to half of ``rows`` or what clean ones leave; within a label small
    languages are taken whole (documents without ``lang`` are one language). Nulls and repeats are
    treated as in ``labelled_sample``.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    known = lookup(docs.select("doc_id", lang.alias("lang")), known, ["doc_id"], "inner").groupBy("doc_id")
    known = known.agg(F.max("label").alias("label"), F.min("lang").alias("lang"))
    known = materialize(known.select("doc_id", "label", F.concat((F.col("label") > 0).cast("int"), "lang").alias("stratum")))
    counts = {r["stratum"]: r["count"] for r in known.groupBy("stratum").count().collect()}
    kinds = [{k: n for k, n in counts.items() if k[0] == kind} for kind in "01"]
    clean, toxic = (sum(kind.values()) for kind in kinds)
    toxic_room = min(toxic, rows - min(clean, rows // 2))
    shares = [_caps(kinds[0], min(clean, rows - toxic_room)), _caps(kinds[1], toxic_room)]
    drawn = [sum(n * shares[k][key] for key, n in kinds[k].items()) for k in (0, 1)]
    shift = math.log(drawn[1] / toxic / (drawn[0] / clean)) if min(drawn) > 0 else 0.0
    share = F.lit(0.0)
    for key, value in {**shares[0], **shares[1]}.items():
        share = F.when(F.col("stratum") == key, value).otherwise(share)
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = lookup(texts, known.select("doc_id", "label"), ["doc_id"], "inner")
    return found.dropDuplicates(["doc_id"]).select("doc_id", "label", "text"), shift


def evidence(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Factor of each feature: a fifth of its likelihood ratio statistic against the share of toxic texts.

    Words in few texts thus learn as fast as frequent ones if those texts agree. Features that chance
    explains (a statistic up to 7) keep a factor of 0.2; 100 is the most that counts.
    """
    none = np.zeros(0, np.int32)
    n = np.bincount(np.concatenate([none, *(at for at, _ in rows)]), minlength=DIM)
    k = np.bincount(np.concatenate([none, *(rows[i][0] for i in np.flatnonzero(toxic))]), minlength=DIM)
    share = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < share < 1:
        return np.ones(DIM, np.float32)
    seen, gain = np.maximum(n, 1), np.zeros(DIM)
    for part, chance in ((k, share), (n - k, 1 - share)):
        gain += 2 * part * np.log(np.maximum(part, 1) / (seen * chance))
    return np.where(gain > 7, np.minimum(gain, 100) / 5, 0.2).astype(np.float32)


def _fit(epochs: int, skips: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, rows = [], []
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text")):
                words = words_of(data, offsets)
                rows += rows_of(word_features(words, skips), words.first)
                labels += batch.column("label").slice(row, len(offsets) - 1).to_pylist()
        toxic = np.array(labels, np.int64) > 0
        factor = evidence(rows, toxic)
        for i, (at, x) in enumerate(rows):
            rows[i] = at, x * factor[at]
        at, weight, bias = fit(rows, [toxic], epochs, 1, l1=2.0)[0].sparse()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[at, -1]), pa.array(np.r_[weight * factor[at], bias])], ["feature", "weight"]
        )

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = 12000, epochs: int = 8, skips: int = 1) -> ToxicityModel:
    """Fit on a sample of about ``rows`` labelled documents outside the held-out fold, toxic ones first.

    The sample is bounded by the parameter, so one task holds it; the order of the steps is a seeded
    shuffle of the rows sorted by id. All features of the sample learn, by their ``evidence``, and L1
    leaves few weights, which are what is broadcast. The bias is set back to the share of toxic labels.
    """
    sample, shift = toxic_first_sample(docs, labels, rows)
    sample = sample.repartition(1).sortWithinPartitions("doc_id")
    fitted = sample.select("label", "text").mapInArrow(_fit(epochs, skips), "feature long, weight double").toArrow()
    at, weight = fitted["feature"].to_numpy(), fitted["weight"].to_numpy()
    return ToxicityModel(at[at >= 0], weight[at >= 0], float(weight[at < 0].sum()) - shift)


def _score(shared, skips: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ToxicityModel = shared.value
        weights = Weights([(model.at, model.weight)])
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text")):
                words = words_of(data, offsets)
                z = model.bias + margins(weights, word_features(words, skips), words.first)[:, 0]
                score = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                part = batch.slice(row, len(score))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(score),
                        pa.array((score >= 0.5).astype(np.int32)),
                    ],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return run


def score(docs: DataFrame, model: ToxicityModel, skips: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; only the text decides.

    Null and empty texts get the score of the bias alone. Equal texts get equal scores. Rows come back
    as often as they are given.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    types = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return rows.mapInArrow(_score(shared, skips), types)
