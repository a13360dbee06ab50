"""Passages that repeat across documents, found with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words; a word is removed where a window over it also starts in a document
with a smaller doc_id. Only documents that can match meet: each window is sent by its least hash of ``GRAM``
consecutive words, which all its copies share, and only where texts of two doc_ids hold that hash. Runs of
windows with one hash are pieces of text; equal pieces are one, with their least doc_id. A shard indexes the
distinct pieces of its hashes, and the pieces of all documents are streamed against it by backward search,
which reports every window with the least doc_id that holds it. Hashes that very many texts hold come last
in the order of hashes of the windows they would have taken, so text next to them splits their windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.files import filesystem, write_file
from lakewright.llm.fm_index import FMIndex
from lakewright.llm.textbatch import CHUNK_BYTES, _powers, chunks, mix, small_batches
from lakewright.session import materialize, scratch_path

WINDOW = 50
GRAM = 8
HOT = 4000  # holders of a hash from which on its windows look for another one
SHARD_WORDS = 400_000
SHARD_PIECES = 1 << 14  # pieces searched at once
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_GAP = re.compile(rb"[ \t-\r]")
_FACTORS = [np.uint64(0x9E3779B97F4A7C15 * (2 * j + 3) & (1 << 64) - 1) for j in range(64)]
_HOT_BITS = 1 << 20
SALTS = 4


def blocks(raw: bytes) -> Iterator[bytes]:
    """A text in blocks of about ``CHUNK_BYTES``, cut at white space."""
    a = 0
    while a < len(raw):
        gap = _GAP.search(raw, a + CHUNK_BYTES) if len(raw) - a > CHUNK_BYTES else None
        b = gap.start() if gap else len(raw)
        yield raw[a:b]
        a = b


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words of a run of texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return start, end, mix((total[end] - total[start]) * down[start])


class Chunk:
    """Words of a run of whole texts and the least gram hash of each of their windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.raw, self.window = data.tobytes(), window
        parts, at = [], 0
        if len(offsets) > 2:
            parts = [_words(data, offsets)]
        else:
            for block in blocks(self.raw):  # one text of any length
                start, end, hashes = _words(np.frombuffer(block, np.uint8), np.zeros(1, np.int64))
                parts.append((start + at, end + at, hashes))
                at += len(block)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.start, self.end, self.hash = (np.concatenate(x) for x in zip(none, *parts))
        self.first = np.searchsorted(self.start, offsets)  # of each text, and the end
        n = len(self.hash)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.window_text = np.where(text[: max(n - window + 1, 0)] == text[window - 1 :], text[: max(n - window + 1, 0)], -1)
        self.size = min(GRAM, window)
        grams = max(n - self.size + 1, 0)
        self.grams = mix(sum((self.hash[j : j + grams] * _FACTORS[j] for j in range(self.size)), np.zeros(grams, np.uint64)))

    def least(self, hot: np.ndarray | None = None) -> np.ndarray:
        """Least hash of each window's grams; hashes with a bit in ``hot`` count as greater than all others."""
        now = self.grams >> np.uint64(1)
        if hot is not None:
            now = now | hot[(now % np.uint64(len(hot))).astype(np.int64)].astype(np.uint64) << np.uint64(63)
        wanted, span = self.window - self.size + 1, 1
        while span < wanted:
            step = min(span, wanted - span)
            now = np.minimum(now[:-step], now[step:]) if len(now) > step else now[:0]
            span += step
        return now & np.uint64((1 << 63) - 1)

    def runs(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number and text of the runs of windows of one text with one hash, ``window`` at most."""
        n = len(least)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        text = self.window_text
        begin = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])]))
        size = np.diff(begin, append=n)
        parts = -(-size // self.window)
        begin = np.repeat(begin, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * self.window
        size = np.diff(begin, append=n)
        kept = text[begin] >= 0
        return begin[kept], size[kept], text[begin[kept]]

    def words(self, window: int, n: int) -> bytes:
        """Words of ``n`` windows from one on, a space between them."""
        return b" ".join(self.raw[self.start[window] : self.end[window + n + self.window - 2]].split())


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")
    )


def _sample(window: int):
    names = ["k1", "k2", "doc_id", "hash", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text")):
                chunk = Chunk(data, offsets, window)
                least = chunk.least()
                begin, size, text = chunk.runs(least)
                keys = [batch.column(c).take(pa.array(row + text)) for c in names[:3]]
                place = begin - chunk.first[text]
                columns = [*keys, *map(pa.array, (least[begin].astype(np.int64), place, size))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _pieces(window: int, hot: np.ndarray):
    names = ["k1", "k2", "doc_id", "route", "start", "n", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in names[:3]]
            wanted = batch.column("runs").to_pylist()
            for row, data, offsets in chunks(batch.column("text")):
                chunk = Chunk(data, offsets, window)
                out: list[tuple] = []
                again = [r["start"] + chunk.first[i] for i in range(len(offsets) - 1) for r in wanted[row + i] if r["hot"]]
                split = {}
                if again:
                    least = chunk.least(hot)
                    begin, size, _ = chunk.runs(least)
                    split = {a: (n, h) for a, n, h in zip(begin.tolist(), size.tolist(), least[begin].tolist())}
                    begins = np.array(begin)
                for i in range(len(offsets) - 1):
                    key = [k[row + i] for k in keys]
                    first = int(chunk.first[i])
                    taken = set()
                    for r in wanted[row + i]:
                        at = r["start"] + first
                        if not r["hot"]:
                            out.append((*key, r["hash"], r["start"], r["n"], chunk.words(at, r["n"])))
                            continue
                        # The runs of the second order that hold any of these windows, whole.
                        a, b = np.searchsorted(begins, [at, at + r["n"] - 1], "right") - 1
                        for p in begins[a : b + 1].tolist():
                            if p not in taken:
                                taken.add(p)
                                n, h = split[p]
                                out.append((*key, h, p - first, n, chunk.words(p, n)))
                if out:
                    columns = [pa.array(list(c)) for c in zip(*out)]
                    columns[6] = columns[6].cast(pa.string())
                    columns = [c if i == 6 else c.cast(pa.int64()) for i, c in enumerate(columns)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _sequences(batch: pa.RecordBatch | pa.Table) -> list[list[bytes]]:
    return [w.as_py().encode().split(b" ") for w in batch.column("words")]


def _build(folder: str, window: int):
    """One index file per shard, from its distinct pieces; the pieces go on with the shard they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
        if held:
            table = pa.Table.from_batches(held)
            shard = table.column("shard")[0].as_py()
            index = FMIndex.build(_sequences(table), table.column("doc_id").to_numpy(), window)
            write_file(f"{folder}/{shard:08d}.fm", index.to_bytes())
            yield from held

    return run


def _search(folder: str):
    """Streams pieces against the index of their shard; a shard's file is opened as its pieces come."""
    kind = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64()), ("least", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, index = None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(shards, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shards)]):
                part = batch.slice(a, b - a)
                if opened != shards[a]:
                    system, path = filesystem(f"{folder}/{shards[a]:08d}.fm")
                    with system.open_input_stream(path) as file:
                        opened, index = shards[a], FMIndex.from_bytes(file.read())
                for c in range(0, part.num_rows, SHARD_PIECES):
                    step = part.slice(c, SHARD_PIECES)
                    found = [_intervals(x) for x in index.search(_sequences(step))]
                    columns = [step.column("p1"), step.column("p2"), pa.array(found, kind)]
                    yield pa.RecordBatch.from_arrays(columns, ["p1", "p2", "found"])

    return run


def _intervals(least: np.ndarray) -> list[dict]:
    """Runs of windows with one least doc_id."""
    begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(begin, append=len(least))
    return [{"at": a, "n": n, "least": v} for a, n, v in zip(begin.tolist(), size.tolist(), least[begin].tolist())]


def _shards(folder: str, pieces: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Distinct pieces with their shard; writes the shards' indexes."""
    distinct = pieces.groupBy("p1", "p2").agg(
        F.min("doc_id").alias("doc_id"), F.first("route").alias("route"), F.first("n").alias("n"), F.first("words").alias("words")
    )
    size = pieces.select("p1", "p2", "n").distinct().agg(F.sum(F.col("n") + window)).first()[0] or 0
    shards = max(1, -(-int(size) // shard_words))
    dealt = distinct.repartition(shards, "route").withColumn("shard", F.spark_partition_id().cast("long"))
    schema = "p1 long, p2 long, doc_id long, words string, shard long"
    return materialize(dealt.select("p1", "p2", "doc_id", "words", "shard").mapInArrow(_build(folder, window), schema))


def _join(big: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of which one may hold a third of ``big``, at every size alike: keys are salted a little."""
    salted = big.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def shared_texts(docs: DataFrame, window: int, hot: int) -> tuple[DataFrame, np.ndarray]:
    """(k1, k2, least_id, text, runs): texts with windows that two doc_ids may share; and the bits of hot hashes.

    Equal texts are one row with their least doc_id; texts without a doc_id take no part.
    """
    keyed = _keyed(docs.where("doc_id IS NOT NULL"))
    schema = "k1 long, k2 long, doc_id long, hash long, start long, n long"
    sampled = materialize(keyed.mapInArrow(_sample(window), schema))
    held = sampled.groupBy("hash").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.count(F.lit(1)) > hot).alias("hot")
    )
    shared = materialize(held.where("low < high").select("hash", "hot"))
    # One bit per remainder, whatever the number of hot hashes; a bit set by another hash does no harm.
    bits = np.zeros(_HOT_BITS, np.uint8)
    for (bit,) in shared.where("hot").select(F.col("hash") % _HOT_BITS).distinct().collect():
        bits[bit] = 1
    runs = _join(sampled.drop("doc_id"), shared, ["hash"], "inner").groupBy("k1", "k2").agg(
        F.collect_set(F.struct("hash", "start", "n", "hot")).alias("runs")
    )
    # Copies of a text become one row before they are sent.
    texts = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("least_id"), F.first("text").alias("text"))
    return materialize(texts.join(runs, ["k1", "k2"])), bits


def window_holders(texts: DataFrame, bits: np.ndarray, window: int, shard_words: int) -> DataFrame:
    """(k1, k2, found): per text its shared windows, each with the least doc_id that holds it.

    ``found`` lists (start, runs) pairs; a run is (at, n, least): the windows start + at and the n - 1 after
    it are first held by the document ``least``. Windows outside all runs are in one doc_id alone.
    """
    schema = "k1 long, k2 long, doc_id long, route long, start long, n long, words string"
    rows = texts.select("k1", "k2", F.col("least_id").alias("doc_id"), "text", "runs")
    pieces = rows.mapInArrow(_pieces(window, bits), schema)
    pieces = materialize(pieces.withColumn("p1", F.xxhash64("words")).withColumn("p2", F.xxhash64(F.lit(1), "words")))
    folder = scratch_path(texts.sparkSession, "passages")
    distinct = _shards(folder, pieces, window, shard_words)
    found = distinct.mapInArrow(_search(folder), "p1 long, p2 long, found array<struct<at: long, n: long, least: long>>")
    placed = _join(pieces.select("k1", "k2", "start", "p1", "p2"), materialize(found), ["p1", "p2"], "inner")
    return placed.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "found")).alias("found"))


def _kept(text: str | None, spans: np.ndarray) -> tuple[int, int, str]:
    """Words of a text, how many of them lie in spans, and the digest of the others."""
    digest, n_words, n_left = hashlib.sha256(), 0, 0
    for block in blocks((text or "").encode()):
        left = words = block.split()
        if len(spans):
            gone = _covered(spans, n_words, len(words))
            left = [w for w, g in zip(words, gone.tolist()) if not g]
        n_words += len(words)
        if left:
            digest.update((b" " if n_left else b"") + b" ".join(left))
        n_left += len(left)
    return n_words, n_words - n_left, digest.hexdigest()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with the number and the digest of all its words."""
    nothing = np.zeros((0, 2), np.int64)
    for batch in batches:
        facts = [_kept(t.as_py(), nothing) for t in batch.column("text")]
        columns = [pa.array([f[0] for f in facts], pa.int64()), pa.array([f[2] for f in facts], pa.string())]
        names = ["doc_id", "k1", "k2"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + columns, [*names, "n_words", "sha_all"])


def _remove(window: int):
    """Per text what is left of it in the document of its least id and in later ones."""
    names = ["k1", "k2", "least_id", "n_first", "sha_first", "n_later", "sha_later"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            rows = (batch.column(c) for c in ("least_id", "text", "found"))
            for least, text, found in zip(*rows):
                least, found = least.as_py(), found.as_py()
                spans = [
                    (f["start"] + r["at"], f["start"] + r["at"] + r["n"] + window - 1, r["least"])
                    for f in found
                    for r in f["found"]
                ]
                facts = []
                for earlier in (least, None):  # a later document finds every window in the least one
                    gone = _merged([s[:2] for s in spans if earlier is None or s[2] < earlier])
                    facts += _kept(text.as_py(), gone)[1:]
                out.append((least, *facts))
            kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()
            columns = [batch.column("k1"), batch.column("k2"), *(pa.array(list(c), k) for c, k in zip(zip(*out), kinds))]
            if out:
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _merged(spans: list[tuple[int, int]]) -> np.ndarray:
    """Spans (start, end) joined where they overlap or touch, in order."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    start, end = np.array(sorted(spans), np.int64).T
    end = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return np.column_stack([start[new], end[np.append(new[1:], True)]])


def _covered(spans: np.ndarray, first: int, n: int) -> np.ndarray:
    """Which of the words first to first + n - 1 lie in one of the merged spans."""
    a, b = np.searchsorted(spans[:, 1], first, "right"), np.searchsorted(spans[:, 0], first + n)
    edges = np.zeros(n + 1, np.int64)
    ends = np.clip(spans[a:b] - first, 0, n)
    np.add.at(edges, ends[:, 0], 1)
    np.add.at(edges, ends[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    A word is removed where a window of the input over it also starts in a document with a smaller doc_id.
    Null and empty texts have no words; texts shorter than a window lose none, and texts of any length are
    read in blocks. Rows that share a doc_id are one document's texts: they do not remove each other's words.
    A row without a doc_id loses no word and removes none. An empty table gives no row. Other columns are
    neither read nor returned.
    """
    small_batches(docs)
    texts, bits = shared_texts(docs, window, hot)
    found = texts.drop("runs").join(window_holders(texts, bits, window, shard_words), ["k1", "k2"])
    schema = "k1 long, k2 long, least_id long, n_first long, sha_first string, n_later long, sha_later string"
    left = materialize(found.mapInArrow(_remove(window), schema))
    rows = _keyed(docs).mapInArrow(_whole, "doc_id long, k1 long, k2 long, n_words long, sha_all string")
    joined = _join(rows, left, ["k1", "k2"], "left")
    first, later = F.col("doc_id") == F.col("least_id"), F.col("doc_id") > F.col("least_id")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(first, F.col("n_first")).when(later, F.col("n_later")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(first, F.col("sha_first")).when(later, F.col("sha_later")).otherwise(F.col("sha_all")).alias("kept_sha256"),
    )
