"""Nearest neighbours by learned partitions.

On a bounded sample the graph of nearest neighbours is cut into equal parts: parts start as balanced
clusters and vertices then move or swap towards the part that holds most of their neighbours, with the
size of a part held near the mean. A softmax classifier learns the part of a vector. It assigns every row
of the table to its likeliest part, and sends a query to its most probable parts, as many as the recall
measured on the sample asks for. In those parts all vectors are ranked exactly, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.textbatch import whole_groups
from lakewright.session import materialize

BLOCK = 4096


class Router(NamedTuple):
    weight: np.ndarray  # (dimensions + 1, parts)
    probes: int


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, some component not zero, no null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _near(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row by cosine, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out[a : a + 1024] = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12) -> np.ndarray:
    """Part of each vertex of the neighbour graph: few cut edges, no part above ``slack`` times the mean."""
    n = len(x)
    limit = int(np.ceil(slack * n / parts))
    draw = np.random.default_rng(7)
    centre = x[draw.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(8):
        sims = x @ centre.T
        size = np.zeros(parts, np.int64)
        order = np.argsort(-sims.max(axis=1), kind="stable")
        likes = np.argsort(-sims, axis=1, kind="stable")
        for i in order.tolist():
            for p in likes[i].tolist():
                if size[p] < limit:
                    part[i] = p
                    size[p] += 1
                    break
        for p in range(parts):
            if size[p]:
                centre[p] = x[part == p].mean(axis=0)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in draw.permutation(n).tolist():
            votes = np.bincount(part[near[i]], minlength=parts)
            votes[size >= limit] = -1
            best, own = int(votes.argmax()), part[i]
            if best != own and votes[best] > np.count_nonzero(part[near[i]] == own):
                size[own] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


def _softmax_fit(x: np.ndarray, part: np.ndarray, parts: int, steps: int = 300) -> np.ndarray:
    """Weights of a linear softmax classifier, by gradient steps with momentum."""
    rows = np.c_[x, np.ones(len(x))]
    w, v = np.zeros((rows.shape[1], parts)), 0.0
    goal = np.eye(parts)[part]
    for _ in range(steps):
        p = _softmax(rows @ w)
        v = 0.9 * v - 4.0 * (rows.T @ (p - goal) / len(rows) + 1e-4 * w)
        w = w + v
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    vectors: DataFrame,
    vector: str = "embedding",
    sample: int = 4096,
    parts: int = 16,
    degree: int = 10,
    recall: float = 0.96,
    k: int = 5,
) -> Router:
    """Fit on about ``sample`` distinct vectors, drawn by a hash of the vector.

    ``probes`` is the least number of parts whose vectors hold the share ``recall`` of the sample's true
    ``k`` nearest. Fewer than two parts' worth of vectors give one part, and the search is exact.
    """
    rows = vectors.where(usable(F.col(vector))).select(F.col(vector).alias("v")).withColumn("h", F.xxhash64("v"))
    n, dims = rows.agg(F.approx_count_distinct("h"), F.max(F.size("v"))).first()
    draw = F.pmod(F.xxhash64("v", F.lit("sample")), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(n, 1))
    drawn = rows.where(draw & (F.size("v") == (dims or 0))).dropDuplicates(["h"]).orderBy("h").select("v").toArrow()
    got = np.array(drawn["v"].to_pylist(), np.float64)
    parts = min(parts, len(got) // 64)
    if parts < 2:
        return Router(np.zeros(((dims or 0) + 1, 1)), 1)
    x = _units(got)
    near = _near(x, min(degree, len(x) - 1))
    part = balanced_parts(x, near, parts)
    w = _softmax_fit(x, part, parts)
    p = _softmax(np.c_[x, np.ones(len(x))] @ w)
    home, order = p.argmax(axis=1), np.argsort(-p, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], axis=1)
    needed = np.take_along_axis(place, home[near[:, :k]], axis=1)
    found = [(needed < probes).mean() for probes in range(1, parts + 1)]
    return Router(w, 1 + next(i for i, r in enumerate(found) if r >= recall or i == parts - 1))


def _route(shared, probes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router: Router = shared.value
        dims, parts = router.weight.shape[0] - 1, router.weight.shape[1]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column("v").to_pylist()
            fits = np.array([len(v) == dims for v in lists])
            order = np.zeros((len(lists), parts), np.int64)
            order[:] = np.arange(parts)
            if fits.any():
                x = _units(np.array([v for v, ok in zip(lists, fits) if ok], np.float64))
                order[fits] = np.argsort(-(np.c_[x, np.ones(len(x))] @ router.weight), axis=1, kind="stable")
            # Vectors of another length are in part 0 and are looked for there.
            take = min(router.probes, parts) if probes else 1
            at = np.repeat(np.arange(len(lists)), take)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.array(order[:, :take].reshape(-1))],
                ["id", "v", "part"],
            )

    return run


def _rank(k: int):
    """The ``k`` nearest candidates of each query of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "gid"):
            gid = table.column("gid").to_numpy()
            query = table.column("is_query").to_numpy(zero_copy_only=False)
            ids = table.column("id").to_numpy()
            vectors = table.column("v").to_pylist()
            cuts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1], True])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                size = np.array([len(v) for v in vectors[lo:hi]])
                for dims in np.unique(size):
                    at = lo + np.flatnonzero(size == dims)
                    q, c = at[query[at]], at[~query[at]]
                    if not len(q) or not len(c):
                        continue
                    c = c[np.argsort(ids[c], kind="stable")]
                    x, y = (np.array([vectors[i] for i in w], np.float64) for w in (q, c))
                    norms = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
                    for a in range(0, len(q), 256):
                        s = (x[a : a + 256] @ y.T) / norms[0][a : a + 256, None] / norms[1][None, :]
                        s[ids[q[a : a + 256]][:, None] == ids[c][None, :]] = -np.inf
                        best, score = _top(s, k, x[a : a + 256], y, norms[0][a : a + 256], norms[1])
                        ok = score > -np.inf
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.repeat(ids[q[a : a + 256]], best.shape[1])[ok.reshape(-1)]),
                                pa.array(ids[c][best][ok]),
                                pa.array(score[ok]),
                            ],
                            ["query_id", "vec_id", "score"],
                        )

    return run


def _top(s: np.ndarray, k: int, x: np.ndarray, y: np.ndarray, xn: np.ndarray, yn: np.ndarray):
    """Places and scores of the k nearest of each row, nearest first, ties to the earlier place.

    The matrix product rounds equal pairs differently, so what is near the edge is scored pair by pair.
    """
    k = min(k, s.shape[1])
    edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    places, scores = np.zeros((len(s), k), np.int64), np.full((len(s), k), -np.inf)
    for i, row in enumerate(s):
        near = np.flatnonzero((row >= edge[i] - 1e-9) & (row > -np.inf))
        exact = (x[i] * y[near]).sum(axis=1) / (xn[i] * yn[near])
        order = np.argsort(-exact, kind="stable")[:k]
        places[i, : len(order)], scores[i, : len(order)] = near[order], exact[order]
    return places, scores


def search(
    vectors: DataFrame,
    queries: DataFrame,
    router: Router,
    k: int = 5,
    ids: str = "vec_id",
    vector: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each query, by cosine.

    Nearest first, ties to the smaller id; a query's own id is no candidate. Vectors that are null, zero
    or hold a null or non-finite component take no part, nor do rows without an id. Vectors of different
    lengths are never compared. Repeated rows (same id and vector) count once.

    Equal vectors are ranked once: of each distinct vector the ``k`` + 1 smallest ids are candidates,
    since no others can be among the nearest. Parts of any size are cut into blocks of vectors and of
    queries, and each pair of blocks is a group of its own.
    """
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(router)

    def clean(frame: DataFrame) -> DataFrame:
        ok = usable(F.col(vector)) & F.col(ids).isNotNull()
        return frame.where(ok).select(F.col(ids).cast("long").alias("id"), F.col(vector).alias("v"))

    salted = clean(vectors).withColumn("h", F.xxhash64("v")).dropDuplicates(["id", "h"])
    salted = salted.withColumn("salt", F.spark_partition_id())
    for keys in (["h", "v", "salt"], ["h", "v"]):  # a very common vector is thinned in each partition first
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        salted = salted.withColumn("place", place).where(F.col("place") <= k + 1)
    route = "id long, v " + vectors.schema[vector].dataType.simpleString() + ", part long"
    pool = materialize(salted.select("id", "v").mapInArrow(_route(shared, False), route))
    asked = materialize(clean(queries).dropDuplicates(["id"]).mapInArrow(_route(shared, True), route))
    count = lambda rows, name: rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = F.broadcast(count(pool, "c").join(count(asked, "q"), "part"))  # one row per part of the router

    def grid(rows: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
        rows = rows.join(sizes, "part").withColumn(own + "b", F.pmod(F.xxhash64("id", "part"), F.col(own)).cast("int"))
        rows = rows.withColumn(other + "b", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return rows.select(F.xxhash64("part", "cb", "qb").alias("gid"), F.lit(is_query).alias("is_query"), "id", "v")

    groups = grid(pool, "c", "q", False).union(grid(asked, "q", "c", True)).repartition("gid").sortWithinPartitions("gid")
    near = groups.mapInArrow(_rank(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # The few best of each block meet per query: at most k for each block that a query was sent to.
    return (
        near.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
