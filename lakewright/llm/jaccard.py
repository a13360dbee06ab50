"""Similarity join of documents on word n-grams: MinHash bands, then exact verification.

1. One pass over the texts gives each document the digest of its n-gram set and its MinHash values.
   Documents with equal sets are one *text* from here on, whatever their number.
2. ``choose_bands`` picks rows and bands for the wanted recall at the threshold. Texts are shuffled on
   (band, hash of the band's values).
3. A bucket of any size is cut into blocks of ``BLOCK`` texts, and each pair of blocks is a group of its
   own, so no task gets a whole bucket. A pair of texts belongs to the first band it shares and is looked
   at there only. Pairs never become rows: a group emits which of its texts need their full sets.
4. The full n-gram sets of those texts are compared. A group emits the number of links of each text and
   a spanning forest of its links; components of the forests are the classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.components import components
from lakewright.llm.textbatch import chunks, shingles_of, small_batches, whole_groups, words_of
from lakewright.operators.skew import lookup
from lakewright.session import materialize

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
BLOCK = 256
PAIR_SLAB = 8192


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows per band whose bands reach ``recall`` at ``threshold`` within the budget.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands; more rows mean fewer
    dissimilar pairs in a bucket.
    """
    best = None
    for rows in range(1, max_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(1, 2**63, n, np.uint64) | np.uint64(1), draw.integers(1, 2**63, n, np.uint64)


def _minhash(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash values (texts x n) of non-empty sets."""
    mult, add = _factors(n)
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), n), np.uint32)
    for j in range(n):
        out[:, j] = np.minimum.reduceat(((values * mult[j] + add[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _binary(rows: list[bytes | None]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _fingerprint(size: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for row, data, offsets in chunks(column):
                sets = shingles_of(words_of(data, offsets), size)
                filled = [i for i, s in enumerate(sets) if len(s)]
                keys, signs = [None] * len(sets), [None] * len(sets)
                if filled:
                    values = _minhash([sets[i] for i in filled], hashes)
                    for i, line in zip(filled, values):
                        keys[i] = hashlib.blake2b(sets[i], digest_size=16).digest()
                        signs[i] = line.tobytes()
                part = batch.slice(row, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_hash"), _binary(keys), _binary(signs)],
                    ["doc_id", "row_hash", "key", "sign"],
                )

    return run


def _shingle_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text")):
                sets = shingles_of(words_of(data, offsets), size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(row, len(sets)), _binary([s.tobytes() for s in sets])], ["key", "grams"]
                )

    return run


def _band_rows(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint32).reshape(-1, bands, rows)
            h = np.zeros(values.shape[:2], np.uint64)
            for r in range(rows):
                h = (h ^ values[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            band = np.tile(np.arange(bands, dtype=np.int32), len(values))
            keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(values)), bands)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(band), pa.array(h.reshape(-1).view(np.int64)), keys], ["band", "bucket", "key"]
            )

    return run


def _pairs_of(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of a group: across its two blocks, or within its only one (side 0 and 1 mark the blocks)."""
    if (sides == 2).all():
        return np.triu_indices(len(sides), 1)
    a, b = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _choose_mates(bands: int, rows: int, least: float):
    """Per group: the texts with a pair to verify, and the places of their partners in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "gid"):
            gid = table.column("gid").to_numpy()
            band = table.column("band").to_numpy()
            side = table.column("side").to_numpy()
            signs = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint32).reshape(len(gid), bands, rows)
            cuts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1], True])
            left, right, held = [], [], 0
            mates: dict[int, list[int]] = {}

            def look() -> None:
                a, b = np.concatenate(left), np.concatenate(right)
                for at in range(0, len(a), PAIR_SLAB):
                    x, y = a[at : at + PAIR_SLAB], b[at : at + PAIR_SLAB]
                    same = signs[x] == signs[y]
                    good = same.mean(axis=(1, 2)) >= least
                    good &= same.all(axis=2).argmax(axis=1) == band[x]
                    for i, j in zip(x[good].tolist(), y[good].tolist()):
                        mates.setdefault(i, []).append(j)
                        mates.setdefault(j, [])
                left.clear()
                right.clear()

            for lo, hi in zip(cuts[:-1], cuts[1:]):
                x, y = _pairs_of(side[lo:hi])
                left.append(x + lo)
                right.append(y + lo)
                held += len(x)
                if held > 8 * PAIR_SLAB:
                    look()
                    held = 0
            if left:
                look()
            if mates:
                places = sorted(mates)
                at = pa.array(places)
                yield pa.RecordBatch.from_arrays(
                    [
                        table.column("gid").take(at).combine_chunks(),
                        pa.array(places, pa.int64()),
                        table.column("key").take(at).combine_chunks(),
                        pa.array([mates[i] for i in places], pa.list_(pa.int64())),
                    ],
                    ["gid", "place", "key", "mates"],
                )

    return run


def _links(threshold: float):
    """Per group: number of linked documents of each text, and edges that connect what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "gid"):
            gid, place = table.column("gid").to_numpy(), table.column("place").to_pylist()
            key, copies = table.column("key").to_pylist(), table.column("copies").to_numpy()
            grams = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
            mates = table.column("mates").to_pylist()
            sizes = np.array(list(map(len, grams)))
            where = {(g, p): i for i, (g, p) in enumerate(zip(gid.tolist(), place))}
            linked = np.zeros(len(key), np.int64)
            parent = list(range(len(key)))

            def root(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            us, vs = [], []
            for i, others in enumerate(mates):
                if not others:
                    continue
                js = np.array([where[gid[i], p] for p in others])
                values = np.concatenate([grams[j] for j in js])
                found = grams[i][np.minimum(np.searchsorted(grams[i], values), sizes[i] - 1)] == values
                shared = np.add.reduceat(found.astype(np.int64), np.r_[0, np.cumsum(sizes[js])[:-1]])
                for j in js[shared >= threshold * (sizes[i] + sizes[js] - shared) - 1e-9].tolist():
                    linked[i] += copies[j]
                    linked[j] += copies[i]
                    a, b = root(i), root(j)
                    if a != b:
                        parent[b] = a
                        us.append(key[i])
                        vs.append(key[j])
            some = np.flatnonzero(linked).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    _binary([key[i] for i in some] + us),
                    _binary([None] * len(some) + vs),
                    pa.array(linked[some].tolist() + [None] * len(us), pa.int64()),
                ],
                ["u", "v", "n"],
            )

    return run


def jaccard_classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    size: int = SIZE,
    recall: float = RECALL,
    max_hashes: int = MAX_HASHES,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: doc_id, row_hash (of doc_id and text), class_id, n_links, class_size.

    Two documents are linked if the Jaccard similarity of their sets of ``size``-word runs is at least
    ``threshold``; ``n_links`` counts the linked documents, copies of the text among them, and
    ``class_id`` is the least doc_id of all documents it is connected to by links. A pair at the
    threshold is found with probability ``recall``, a more similar one with a higher probability;
    what is found is verified on the full sets.

    A text of fewer words is one run. Null, empty and wordless texts have no links: class_id is the own
    doc_id. Rows repeat as they are given (each repeated row counts as a document); null doc_ids stay
    null. Columns other than doc_id and text are not looked at.
    """
    small_batches(docs)
    bands, rows = choose_bands(threshold, recall, max_hashes)
    hashes = bands * rows
    # Below this estimate a pair at the threshold falls with a chance of under one in a million.
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / hashes)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    source = docs.withColumn("row_hash", F.xxhash64("doc_id", "text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    prints = materialize(
        source.mapInArrow(_fingerprint(size, hashes), f"doc_id {id_type}, row_hash long, key binary, sign binary")
    )
    texts = materialize(
        prints.where("key is not null")
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.isnull("doc_id").alias("anonymous"), "doc_id", "row_hash", "sign")).alias("first"))
        .select("key", "copies", "first.doc_id", "first.row_hash", "first.sign")
    )
    slots = materialize(
        texts.select("key", "sign").mapInArrow(_band_rows(bands, rows), "band int, bucket long, key binary")
    )
    crowded = slots.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = slots.join(crowded, ["band", "bucket"]).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    paired = (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1))
        .withColumn("gid", F.xxhash64("band", "bucket", F.least("own", "other"), F.greatest("own", "other")))
    )
    # Blocks of one bucket are compared with each other; their own pairs are a group too.
    groups = (
        paired.select("gid", "band", "side", "key")
        .join(texts.select("key", "sign"), "key")
        .repartition("gid")
        .sortWithinPartitions("gid")
    )
    needed = materialize(
        groups.mapInArrow(_choose_mates(bands, rows, least), "gid long, place long, key binary, mates array<long>")
    )
    wanted = needed.select("key").distinct().join(texts.select("key", "row_hash", "copies", "doc_id"), "key")
    bearers = lookup(source, wanted.select("key", "row_hash", F.col("doc_id").alias("_id")), ["row_hash"], "inner")
    bearers = bearers.where(F.col("doc_id").eqNullSafe(F.col("_id"))).select("key", "text")
    grams = bearers.mapInArrow(_shingle_sets(size), "key binary, grams binary").dropDuplicates(["key"])
    verified = materialize(
        needed.join(grams, "key")
        .join(wanted.select("key", "copies"), "key")
        .repartition("gid")
        .sortWithinPartitions("gid")
        .mapInArrow(_links(threshold), "u binary, v binary, n long")
    )
    counts = verified.where("n is not null").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("linked"))
    roots = components(verified.where("v is not null").select("u", "v")).withColumnRenamed("node", "key")
    per_text = (
        texts.select("key", "copies", "doc_id")
        .join(roots, "key", "left")
        .join(counts, "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    classes = per_text.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    per_text = per_text.join(classes, "root").select(
        "key", "class_id", "class_size", F.col("root").alias("class_key"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return prints.select("doc_id", "row_hash", "key").join(per_text, "key", "left").select(
        "doc_id",
        "row_hash",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        "class_key",
    )


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each class: that of the least doc_id.

    Ties go by a hash of doc_id and text; of rows equal in both one stays. Rows without words are no copies
    of each other and all stay. Ids come before null ids.
    """
    classes = materialize(
        jaccard_classes(docs, **options).where("class_key is not null").select("doc_id", "row_hash", "class_key")
    )
    order = F.struct(F.isnull("doc_id").alias("anonymous"), "doc_id", "row_hash")
    winners = materialize(classes.groupBy("class_key").agg(F.min(order).alias("w")).select("w.row_hash"))
    losers = classes.select("row_hash").distinct().join(winners, "row_hash", "left_anti")
    repeated = classes.groupBy("row_hash").count().where("count > 1").join(winners, "row_hash", "left_semi")
    marks = losers.select("row_hash", F.lit(1).alias("_mark")).union(repeated.select("row_hash", F.lit(2)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_row_hash"))
    marked = lookup(rows, materialize(marks.withColumnRenamed("row_hash", "_row_hash")), ["_row_hash"], "left")
    once = marked.where("_mark is null").select("_row.*")
    return once.union(marked.where("_mark = 2").dropDuplicates(["_row_hash"]).select("_row.*"))
