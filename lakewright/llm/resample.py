"""Importance resampling of documents towards a target corpus, over hashed word runs.

Every document is scanned once in a form whose words stand after one space each. The scan keeps the running
CRC-32 at each word end. The CRC of any run of words then follows from two of them: a CRC of ``AB`` is the CRC
of ``A`` shifted by the length of ``B`` over GF(2), xor the CRC of ``B``, so the shifted CRC before the run
cancels out of the one after it. A run's bucket is its CRC modulo ``BUCKETS``; the logarithm of the bucket's
share in the target over that in the documents is its gain, a document weighs the mean of its gains, and a
Gumbel draw per document turns weights into a sample without replacement.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.textbatch import BATCH_ROWS, IS_WORD, LOWER, small_batches
from lakewright.operators.skew import split_scan
from lakewright.session import materialize

BUCKETS = 10_000
RUN = 2  # words of the longest run
PERCENT = 25
MIN_WORDS = 20
SEED = 7
BLOCK_BYTES = 1 << 18  # of text scanned at once; longer texts continue in the next block
_PLAIN = bytes(np.where(IS_WORD, LOWER, 32).astype(np.uint8))
_PIECE = re.compile(rb" [^ ]+")
_NEAR = 64
_POLYNOMIAL = 0xEDB88320


def _byte_steps() -> np.ndarray:
    """CRC register after each byte value, from an empty register."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = (steps >> np.uint32(1)) ^ (steps & np.uint32(1)) * np.uint32(_POLYNOMIAL)
    return steps


_STEP = _byte_steps()


def _tables_of(columns: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its images of the single bits, as four tables by byte."""
    values = np.arange(256, dtype=np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        out[bit // 8] ^= np.where(values >> np.uint32(bit % 8) & np.uint32(1), columns[bit], np.uint32(0))
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0, crc & 255] ^ tables[1, crc >> 8 & 255] ^ tables[2, crc >> 16 & 255] ^ tables[3, crc >> 24]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Shifts by 0 to 63 zero bytes, and by 64, 128, 256 ... bytes."""
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    near = []
    for _ in range(_NEAR):
        near.append(_tables_of(columns))
        columns = _STEP[columns & np.uint32(255)] ^ (columns >> np.uint32(8))
    far = [_tables_of(columns)]
    for _ in range(40):
        columns = _apply(far[-1], columns)
        far.append(_tables_of(columns))
    return np.array(near), far


_SHIFT, _FAR = _shift_tables()


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRCs as they stand in the CRC of a text that is ``n_bytes`` longer."""
    near = n_bytes & (_NEAR - 1)
    crc = (
        _SHIFT[near, 0, crc & 255]
        ^ _SHIFT[near, 1, crc >> 8 & 255]
        ^ _SHIFT[near, 2, crc >> 16 & 255]
        ^ _SHIFT[near, 3, crc >> 24]
    )
    rest, k = n_bytes >> 6, 0
    while rest.any():
        odd = (rest & 1).astype(bool)
        crc[odd] = _apply(_FAR[k], crc[odd])
        rest, k = rest >> 1, k + 1
    return crc


class Scan:
    """Runs of words of texts that arrive block by block, from running CRCs."""

    def __init__(self, run: int = RUN, buckets: int = BUCKETS):
        self.run, self.buckets = run, buckets
        self.kept = (np.zeros(0, np.uint32),) * 2 + (np.zeros(0, np.int64),) * 2
        self.crc = self.at = 0

    def block(self, words: bytes, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the runs that end in this block, and the text of each; ``texts`` names each word's text.

        ``words`` holds the words with one space before each. The last words of the block before it are kept,
        so runs cross blocks of one text.
        """
        pieces = _PIECE.findall(words)
        ends = np.fromiter(accumulate(pieces, lambda c, p: crc32(p, c), initial=self.crc), np.uint32, len(pieces) + 1)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        place = self.at + np.cumsum(sizes)
        # A word begins one space after the end of the word before it.
        before = ends[:-1] ^ np.uint32(0xFFFFFFFF)
        starts = _STEP[(before ^ np.uint32(32)) & np.uint32(255)] ^ (before >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
        old = len(self.kept[0])
        starts, ends = np.concatenate([self.kept[0], starts]), np.concatenate([self.kept[1], ends[1:]])
        begin = np.concatenate([self.kept[2], place - sizes + 1])
        owner = np.concatenate([self.kept[3], texts])
        stop = np.concatenate([self.kept[2] * 0, place])
        buckets, owners = [], []
        for size in range(1, self.run + 1):
            last = np.arange(max(old, size - 1), len(ends))
            first = last - size + 1
            same = owner[first] == owner[last]
            first, last = first[same], last[same]
            crc = ends[last] ^ shifted(starts[first], stop[last] - begin[first])
            buckets.append(crc % np.uint32(self.buckets))
            owners.append(owner[last])
        keep = slice(max(0, len(ends) - self.run + 1), None)
        self.kept = (starts[keep], ends[keep], begin[keep], owner[keep])
        if len(pieces):
            self.crc, self.at = int(ends[-1]), int(place[-1])
        return np.concatenate(buckets), np.concatenate(owners)


def _blocks(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """Normalised words of a column of texts in blocks, cut between words, and the text of each word."""
    parts: list[bytes] = []
    owners: list[tuple[int, int]] = []
    size = 0
    for i, text in enumerate(column):
        raw = (text.as_py() or "").encode().translate(_PLAIN)
        at = 0
        while at < len(raw):
            cut = len(raw)
            if cut - at > BLOCK_BYTES:
                near = raw.rfind(b" ", at, at + BLOCK_BYTES)
                far = raw.find(b" ", at + BLOCK_BYTES)
                cut = near + 1 if near >= at else far + 1 if far >= 0 else cut
            words = raw[at:cut].split()
            parts += words
            owners.append((i, len(words)))
            size += cut - at
            at = cut
            if size >= BLOCK_BYTES:
                yield _joined(parts, owners)
                parts, owners, size = [], [], 0
    if parts:
        yield _joined(parts, owners)


def _joined(words: list[bytes], owners: list[tuple[int, int]]) -> tuple[bytes, np.ndarray]:
    texts, counts = np.array(owners, np.int64).reshape(-1, 2).T
    return b" " + b" ".join(words) if words else b"", np.repeat(texts, counts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        scan = Scan()
        for words, texts in _blocks(batch.column(0)):
            total += np.bincount(scan.block(words, texts)[0], minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Number of word runs of all texts in each bucket; ``BUCKETS`` numbers, whatever the table's size.

    Null and empty texts have none; repeated rows count each time; an empty table has zeros. Other columns
    are not read.
    """
    small_batches(texts)
    counted = texts.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counted.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares of each bucket, rounded down."""
    total, wanted = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * total / ((s + 1) * wanted)))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def _weigh(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(a, BATCH_ROWS)
                n, scan = batch.num_rows, Scan()
                features, total, words = (np.zeros(n, np.int64) for _ in range(3))
                for block, texts in _blocks(batch.column(1)):
                    buckets, owners = scan.block(block, texts)
                    features += np.bincount(owners, minlength=n)
                    np.add.at(total, owners, table[buckets])
                    words += np.bincount(texts, minlength=n)
                weight = np.floor_divide(total, np.maximum(features, 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *map(pa.array, (words, features, weight))],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return run


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED
) -> DataFrame:
    """Weight, score and rank in the draw of every document: doc_id, n_words, n_features, weight, score, rank.

    Of the documents with at least ``min_words`` words the ``percent`` of highest score are drawn and ranked
    from 1; the rank of all others is null. Null and empty texts have no run and weigh 0; texts of any length
    are scanned in blocks. Ties go to the smaller doc_id, null ids last; a null id draws as the empty id.
    Repeated rows share a score and take ranks one after the other. An empty table gives no row, an empty
    target zero counts. Other columns are neither read nor returned. No task holds more than a slab of the
    ranking, however many scores are equal but for the id.
    """
    small_batches(docs)
    table = gains(bucket_counts(docs), bucket_counts(target))
    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _weigh(table), "doc_id long, n_words long, n_features long, weight long"
    )
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    gumbel = F.floor(-1000 * F.log(-F.log(uniform)))
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel))
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = split_scan(able, [], order, out="earlier")
    place = F.when(F.col("earlier") < drawn, F.col("earlier") + 1).cast("long").alias("rank")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < min_words)
    return ranked.select(*columns, place).unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
