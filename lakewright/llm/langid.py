"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: a node is a context of up to ``ORDER`` preceding bytes, its
counts are the bytes that followed. A byte not seen in a context escapes to the next shorter one; the
escape share is that of method C (distinct bytes over occurrences plus distinct bytes), bytes seen in the
longer context are excluded from the shorter one, and the last resort is a uniform byte. So the lengths of
all bytes in a context sum to a proper code, and after training the statistics are frozen: the code length
of a text is a sum of table entries, exact in units of 2^-16 bits. The shortest code wins.

The trees of all languages share the nodes: the most frequent contexts of the training texts. They are
stored as arrays (node, byte) -> longer node and (language, node, byte) -> code length, whose size is
bounded by ``max_contexts``, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.llm.textbatch import chunks, quoted, small_batches
from lakewright.session import materialize

ORDER = 3
UNIT = 1 << 16


class LanguageModel(NamedTuple):
    langs: list[str]
    step: np.ndarray  # (2 nodes, 256): node after reading one more byte of the past; second half has stopped
    bits: np.ndarray  # (languages, nodes * 256) code lengths in units of 2^-16 bits


def held_out(doc_id: Column) -> Column:
    """Documents never used for learning: crc32 of the id's text is divisible by 5. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _windows(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it in its text, zeros before the first: order + 1 rows."""
    rows = [data.astype(np.int64)]
    inside = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, order + 1):
        shifted = np.zeros(len(data), np.int64)
        shifted[back:] = data[:-back] if back < len(data) else shifted[back:]
        shifted[inside < back] = 0
        rows.append(shifted)
    return np.stack(rows)


def _count_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for row, data, offsets in chunks(batch.column("text")):
                here = langs[row : row + len(offsets) - 1]
                rows = _windows(data, offsets, order)
                gram = sum(rows[j] << (8 * j) for j in range(order + 1))
                of = np.repeat(np.arange(len(here)), np.diff(offsets))
                names, code = np.unique(here.astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    values, counts = np.unique(gram[code[of] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(values)), pa.array(values), pa.array(counts)], ["lang", "gram", "n"]
                    )

    return run


def train(docs: DataFrame, per_language: int = 1500, max_contexts: int = 4096, order: int = ORDER) -> LanguageModel:
    """Fit on documents with a language that are not held out.

    ``per_language`` bounds the sample: about so many distinct whole texts of each language, drawn by a
    hash of the text. ``max_contexts`` bounds the nodes of the tree. Learns from text and lang alone.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    known = known.where("lang is not null and text is not null").select("lang", "text")
    known = known.withColumn("h", F.xxhash64("text"))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((2, 256), np.int32), np.zeros((0, 256), np.int32))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / max(n, 1)))])
    drawn = F.pmod(F.xxhash64("text", F.lit("ppm")), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)
    sample = known.where(drawn).dropDuplicates(["lang", "h"]).select("lang", "text")
    grams = sample.mapInArrow(_count_grams(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")
    )
    grams = materialize(grams)
    orders = F.explode(F.array(*[F.lit(o) for o in range(order + 1)])).alias("o")
    low = F.shiftright("gram", 8).bitwiseAND(F.expr("shiftleft(1L, 8 * o) - 1"))
    nodes = (
        grams.select("lang", "gram", "n", orders)
        .groupBy("lang", "o", low.alias("ctx"), F.col("gram").bitwiseAND(255).alias("sym"))
        .agg(F.sum("n").alias("n"))
    )
    nodes = materialize(nodes)
    # A suffix of a context occurs at least as often, so the most frequent contexts are closed under suffixes.
    chosen = (
        nodes.groupBy("o", "ctx").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "o", "ctx").limit(max_contexts)
    )
    contexts = [(r.o, r.ctx) for r in chosen.collect()]
    stats = nodes.join(F.broadcast(chosen.select("o", "ctx")), ["o", "ctx"]).toArrow()
    return _build(langs, sorted(contexts), stats)


def _build(langs: list[str], contexts: list[tuple[int, int]], stats: pa.Table) -> LanguageModel:
    number = {c: i for i, c in enumerate(contexts)}
    m = len(contexts)
    parent = np.zeros(m, np.int64)
    step = np.empty((2 * m, 256), np.int32)
    step[:m] = np.arange(m)[:, None] + m
    step[m:] = np.arange(m)[:, None] + m
    for (o, ctx), i in number.items():
        if o:
            parent[i] = number[(o - 1, ctx & ((1 << (8 * (o - 1))) - 1))]
            step[parent[i], ctx >> (8 * (o - 1))] = i
    at = np.array([number[c] for c in zip(stats["o"].to_pylist(), stats["ctx"].to_pylist())], np.int64)
    sym, n = stats["sym"].to_numpy(), stats["n"].to_numpy()
    code = np.searchsorted(np.array(langs), np.array(stats["lang"].to_pylist(), str))
    bits = np.empty((len(langs), m * 256), np.int32)
    for k in range(len(langs)):
        counts = np.zeros((m, 256))
        mine = code == k
        np.add.at(counts, (at[mine], sym[mine]), n[mine])
        chance = np.empty((m, 256))
        for i in range(m):  # shorter contexts come first
            base = chance[parent[i]] if i else np.full(256, 1 / 256)
            seen = counts[i] > 0
            distinct, total = seen.sum(), counts[i].sum()
            if distinct == 0:
                chance[i] = base
            elif distinct == 256:
                chance[i] = counts[i] / total
            else:
                rest = base * ~seen
                chance[i] = counts[i] / (total + distinct) + rest * (distinct / (total + distinct) / rest.sum())
        bits[k] = np.rint(-np.log2(chance) * UNIT).reshape(-1)
    return LanguageModel(langs, step, bits)


def code_lengths(model: LanguageModel, data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Bits of each text in each language."""
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled) == 0 or not model.langs:
        return out
    rows = _windows(data, offsets, order)
    node = np.zeros(len(data), np.int32)
    for back in range(1, order + 1):
        node = model.step[node, rows[back]]
    m = len(model.step) // 2
    place = np.where(node >= m, node - m, node) * np.int64(256) + rows[0]
    for k in range(len(model.langs)):
        out[filled, k] = np.add.reduceat(model.bits[k][place], offsets[:-1][filled], dtype=np.int64) / UNIT
    return out


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        for batch in batches:
            keep = [n for n in batch.schema.names if n not in ("_text", "_letter")]
            for row, data, offsets in chunks(batch.column("_text")):
                n = len(offsets) - 1
                bits = code_lengths(model, data, offsets)
                letter = np.array(batch.column("_letter").slice(row, n).to_pylist(), bool) & bool(model.langs)
                langs, score, rate = ["und"] * n, np.zeros(n), np.zeros(n)
                if model.langs:
                    best = bits.argmin(axis=1)
                    gap = np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)
                    score = np.where(letter, 1 / np.exp2(gap).sum(axis=1), 0.0)
                    rate = np.where(letter, bits.min(axis=1) / np.maximum(np.diff(offsets), 1), 0.0)
                    langs = [model.langs[b] if ok else "und" for b, ok in zip(best, letter)]
                part = batch.slice(row, n)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(langs), pa.array(score), pa.array(rate)],
                    [*keep, "lang_pred", "score", "bits_per_byte"],
                )

    return run


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row; only the text decides.

    ``lang_pred`` is the language of the shortest code (ties: the first in alphabetical order), ``und``
    with score 0 if the text is null or has no letter, or if nothing was learned. ``score`` is the
    posterior of the language under equal priors. Rows come back as often as they are given.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *_inputs())
    types = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean"
    return rows.mapInArrow(_predict(shared), types + ", lang_pred string, score double, bits_per_byte double")


def _inputs() -> list[Column]:
    return [F.col("text").alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter")]


def keep_identified(docs: DataFrame, model: LanguageModel, reject_bits: float = 8.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known.

    Rejected are texts without a letter, null texts, and texts that no language's tree codes in fewer
    than ``reject_bits`` bits a byte (8: no better than raw bytes).
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"), *_inputs())
    found = T.StructType().add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    told = rows.mapInArrow(_predict(shared), T.StructType([rows.schema["_row"], *found]))
    return told.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") < reject_bits)).select("_row.*")
