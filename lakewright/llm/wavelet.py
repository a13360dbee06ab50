"""Token ids of documents as one wavelet matrix per shard.

A shard holds the ids of consecutive documents, in order of doc_id. Level by level, from the highest bit
of an id to the lowest, the matrix stores one bit per token and moves the tokens with a 0 before those
with a 1. With the number of ones before each 512-bit block, ``rank`` reads one block; ``access``, ``count``
and the place of an occurrence then take one rank or select per level. The planes are compressed in
pieces of ``PIECE`` bytes, so a query unpacks only the pieces it touches.

File: magic, length of the header, header (JSON: counts, levels, place of each section), sections (zstd).
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.files import write_file
from lakewright.llm.textbatch import small_batches, text_bytes
from lakewright.session import materialize, scratch_path

MAGIC = b"LWWM\x01"
BLOCK = 512
PIECE = 1 << 14
SPAN = 1 << 15
SHARD_BYTES = 8 << 20
END = 0
CACHE = 300_000
LONG = 100  # bytes of a piece that is remembered when the memory is full
STEP_BYTES = 4 << 20  # bytes of text encoded at once
# A space after any other character begins a token of its own, whatever stands around it.
_RISKY = re.compile(r"[^\w\x21-\x7e]")


def pieces_of(text: str) -> tuple[str, list[str]]:
    """The text as a head and pieces that each follow one space; no token crosses from one to the next."""
    head, *rest = text.split(" ")
    out: list[str] = [head]
    for piece in rest:
        if out[-1] and not _RISKY.match(out[-1][-1]):
            out.append(piece)
        else:
            out[-1] += " " + piece
    return out[0], out[1:]


def _plain_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts in which every space follows a visible ASCII character or a two-byte letter or sign."""
    at = np.flatnonzero(data == 32)
    one, two = data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
    fine = ((one > 32) & (one < 127)) | ((one >= 128) & (two >= 0xC3) & (two <= 0xDF))
    row = np.searchsorted(offsets, at, "right") - 1
    fine &= at > offsets[row]
    plain = np.ones(len(offsets) - 1, bool)
    plain[row[~fine]] = False
    return plain


_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _BREAK, _VISIBLE = range(8)


def _class_of(byte: int) -> int:
    """Kind of a character by its first byte; characters of ``_OTHER`` may be white space or anything else."""
    if byte < 0x80:
        char = chr(byte)
        if char.isalnum():
            return _LETTER if char.isalpha() else _DIGIT
        named = {" ": _SPACE, "\n": _BREAK, "\r": _BREAK, "\t": _BREAK, "'": _QUOTE}
        return named.get(char, _MARK if 0x20 < byte < 0x7F else _OTHER)
    if 0xC3 <= byte <= 0xC8 or byte in (0xD0, 0xD1):  # U+00C0 to U+023F, U+0400 to U+047F
        return _LETTER
    # No character from U+0240 to U+0FFF or from U+4000 on is white space.
    return _VISIBLE if 0xC9 <= byte <= 0xE0 or byte >= 0xE4 else _OTHER


_CLASSES = np.array(list(map(_class_of, range(256))), np.uint8)
_SEEN = np.isin(np.arange(8), (_LETTER, _DIGIT, _MARK, _QUOTE, _VISIBLE))
_RUNS = np.isin(np.arange(8), (_LETTER, _DIGIT, _MARK))


def _cut_between(a: int, b: int) -> bool:
    """Whether a token always ends between characters of these kinds.

    A token is a run of letters, of digits or of signs, with at most one space before it, or white space, or a
    quote and letters (``'ll``).
    """
    if b in (_SPACE, _BREAK):
        return bool(_SEEN[a])
    return a != b and bool(_RUNS[a]) and (bool(_RUNS[b]) or (b == _QUOTE and a != _MARK))


_CUTS = np.array([_cut_between(a, b) for a in range(8) for b in range(8)])


def _kinds(data: np.ndarray) -> np.ndarray:
    """Kind of the character of each byte."""
    kinds = _CLASSES[data]
    if len(data) and data.max() >= 0x80:
        signs = np.flatnonzero(data[:-1] == 0xC3)
        kinds[signs[np.isin(data[signs + 1], (0x97, 0xB7))]] = _VISIBLE  # multiplication, division
        for size, lead in enumerate((0xC0, 0xE0, 0xF0), 1):
            at = np.flatnonzero(data[:-size] >= lead)
            kinds[at + size] = kinds[at]
    return kinds


def _cuts(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where pieces of texts begin: at each text, and where a token ends whatever follows, but in no ``whole`` text.

    A single line break between visible characters is a token of its own; the tokens of longer white space depend
    on what follows it, so its piece goes on.
    """
    begins = np.zeros(len(data) + 1, bool)
    if len(data):
        kinds = _kinds(data)
        begins[1:-1] = _CUTS[kinds[:-1] << 3 | kinds[1:]]
        at = np.flatnonzero(kinds[1:-1] == _BREAK) + 1
        begins[at[_SEEN[kinds[at - 1]] & _SEEN[kinds[at + 1]]] + 1] = True
    for row in np.flatnonzero(whole):
        begins[offsets[row] : offsets[row + 1]] = False
    begins[offsets[:-1]] = True
    begins[len(data)] = False  # empty texts at the end have no piece
    return np.flatnonzero(begins)


def _strings(data: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The pieces of bytes that begin at these places."""
    offsets = np.append(begins, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _letters() -> np.ndarray:
    """Character that stands for each byte in a byte-level vocabulary: itself if printable, others from U+0100 on."""
    plain = np.isin(np.arange(256), [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
    return np.where(plain, np.arange(256), 0xFF + np.cumsum(~plain)).astype("<u2")


class Encoder:
    """Encodes texts piece by piece and remembers the ids of up to ``CACHE`` pieces.

    When it is full, in pieces or in bytes, it keeps the short pieces that came more than once, the most frequent
    half at most. Pieces of one kind of characters are single tokens of the tokenizer's pattern, so its model merges them directly; all others
    go through the whole tokenizer. Texts that hold an added token (``<|endoftext|>``) are one piece, and so are all
    texts if the tokenizer is not the plain byte-level kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        cutter = made["pre_tokenizer"] or {}
        self.plain = (
            made["normalizer"] is None
            and made["model"]["type"] == "BPE"
            and (cutter.get("type"), cutter.get("use_regex"), cutter.get("add_prefix_space")) == ("ByteLevel", True, False)
        )
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else np.uint32
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # every piece is asked for once, a cache of words is never hit
        self.letters = _letters()
        self.marks = 0  # runs of marks learned as pieces of their own
        self.known = pa.array([], pa.large_string())
        self.seen = np.zeros(0, np.int64)
        # The ids of known piece i follow those of the piece before; the end id is piece 0 there.
        self.ids, self.ends = np.array([END], self.dtype), np.array([0, 1], np.int64)

    def _forget(self) -> None:
        keep = (self.seen >= 2) & (pc.binary_length(self.known).to_numpy() <= LONG)
        if keep.sum() > CACHE // 2:
            keep &= self.seen > np.partition(self.seen, -(CACHE // 2))[-(CACHE // 2)]
        self.known, self.seen = self.known.filter(pa.array(keep)), self.seen[keep]
        keep, sizes = np.append(True, keep), np.diff(self.ends)
        self.ids = self.ids[np.repeat(keep, sizes)]
        self.ends = np.append(0, np.cumsum(sizes[keep]))

    def _holds_added(self, texts: pa.Array) -> np.ndarray:
        held = np.zeros(len(texts), bool)
        for token in self.added:
            held |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        return held

    def _code(self, texts: pa.Array) -> tuple[list[int], list[int]]:
        """Ids of texts in one list, and their number per text."""
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return [i for ids in coded for i in ids], list(map(len, coded))

    def _merge(self, pieces: pa.Array) -> tuple[list[int], list[int]]:
        """As ``_code`` of pieces that are each one token of the tokenizer's pattern."""
        data, offsets = text_bytes(pieces)
        text = self.letters[data].tobytes().decode("utf-16-le")  # a character per byte
        tokenize, places = self.model.tokenize, offsets.tolist()
        coded = [tokenize(text[a:b]) for a, b in zip(places, places[1:])]
        return [token.id for tokens in coded for token in tokens], list(map(len, coded))

    def _add(self, pieces: pa.Array) -> None:
        """Remember pieces, none of them empty or known, with their ids."""
        data, offsets = text_bytes(pieces)
        kinds = _kinds(data)
        first = offsets[:-1]
        led = first[(kinds[first] == _SPACE) & (np.diff(offsets) > 1)]
        kinds[led] = kinds[led + 1]
        kind = np.minimum.reduceat(kinds, first)
        single = (kind == np.maximum.reduceat(kinds, first)) & _RUNS[kind] & self.plain & ~self._holds_added(pieces)
        self.marks += int((single & (kind == _MARK)).sum())
        sizes = np.empty(len(pieces), np.int64)
        ids: list[np.ndarray] = []
        for some, code in ((single, self._merge), (~single, self._code)):
            found, counts = code(pieces.filter(pa.array(some)))
            ids.append(np.array(found, self.dtype))
            sizes[some] = counts
        order = np.repeat(~single, sizes)  # the others' ids, among all in the order of the pieces
        both = np.empty(len(order), self.dtype)
        both[~order], both[order] = ids
        self.ids = np.concatenate([self.ids, both])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.known = pa.concat_arrays([self.known, pieces])
        self.seen = np.concatenate([self.seen, np.zeros(len(pieces), np.int64)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id after each, and the number of ids of each text."""
        if len(self.known) > CACHE or self.known.nbytes > CACHE * LONG:
            self._forget()
        column = column.cast(pa.large_string())
        data, offsets = text_bytes(column)
        begins = _cuts(data, offsets, self._holds_added(column) | (not self.plain))
        coded = _strings(data, begins).dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.known)
        if place.null_count:
            old, new = len(self.known), place.is_null().to_numpy(zero_copy_only=False)
            self._add(coded.dictionary.filter(place.is_null()))
            place = pc.fill_null(place, 0).to_numpy().copy()
            place[new] = np.arange(old, old + new.sum())
        else:
            place = place.to_numpy()
        pieces = coded.indices.to_numpy()
        self.seen[place] += np.bincount(pieces, minlength=len(place))
        row_ends = np.searchsorted(begins, offsets[1:])
        number = np.insert(place[pieces] + 1, row_ends, 0)
        lists = pa.LargeListArray.from_arrays(pa.array(self.ends), pa.array(self.ids)).take(pa.array(number))
        before = np.append(0, np.cumsum(np.diff(self.ends)[number]))
        return lists.flatten().to_numpy(), np.diff(before[row_ends + np.arange(1, len(column) + 1)], prepend=0)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this worker, kept from task to task with the pieces it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class WaveletMatrix:
    """Read access to a shard; unpacks what a call needs."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        at = len(MAGIC) + 4
        size = int.from_bytes(data[at - 4 : at], "little")
        self.head = json.loads(data[at : at + size])
        self.body = memoryview(data)[at + size :]
        self.n, self.levels, self.zeros = self.head["n"], self.head["levels"], self.head["zeros"]
        self._pieces: dict[tuple[int, int], np.ndarray] = {}
        self._ranks: dict[int, np.ndarray] = {}

    @staticmethod
    def build(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray, shard: int) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        sections: list[bytes] = []
        planes, ranks, zeros = [], [], []
        for level in range(levels):
            bit = (now & now.dtype.type(1 << (levels - 1 - level))) != 0
            packed = np.packbits(bit, bitorder="little")
            ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
            zeros.append(int(len(bit) - ones.sum()))
            planes.append([])
            for a in range(0, len(packed), PIECE):
                planes[-1].append(len(sections))
                sections.append(pack(packed[a : a + PIECE].tobytes()))
            ranks.append(len(sections))
            sections.append(pack((np.cumsum(ones) - ones).astype(np.uint32).tobytes()))
            then = np.empty_like(now)
            np.compress(~bit, now, out=then[: zeros[-1]])
            np.compress(bit, now, out=then[zeros[-1] :])
            now = then
        sections.append(pack(json.dumps(doc_ids).encode()))
        sections.append(pack(np.asarray(sizes, np.int64).tobytes()))
        ends = np.cumsum([0, *map(len, sections)]).tolist()
        head = json.dumps(
            {"n": len(ids), "levels": levels, "zeros": zeros, "planes": planes, "ranks": ranks, "shard": shard, "ends": ends}
        ).encode()
        return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(sections)

    def _section(self, i: int) -> bytes:
        a, b = self.head["ends"][i : i + 2]
        return zstandard.ZstdDecompressor().decompress(self.body[a:b])

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """doc_id and number of ids of each document, in file order."""
        last = len(self.head["ends"]) - 1
        return json.loads(self._section(last - 2)), np.frombuffer(self._section(last - 1), np.int64)

    def _piece(self, level: int, piece: int) -> np.ndarray:
        if (level, piece) not in self._pieces:
            self._pieces[level, piece] = np.frombuffer(self._section(self.head["planes"][level][piece]), np.uint8)
        return self._pieces[level, piece]

    def _bit(self, level: int, i: int) -> int:
        byte = i >> 3
        return int(self._piece(level, byte // PIECE)[byte % PIECE] >> (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a level."""
        if i >= self.n:
            return self.n - self.zeros[level]
        if level not in self._ranks:
            self._ranks[level] = np.frombuffer(self._section(self.head["ranks"][level]), np.uint32)
        block = i // BLOCK
        byte = block * BLOCK // 8
        start = byte % PIECE
        part = self._piece(level, byte // PIECE)[start : start + BLOCK // 8]
        bits = np.unpackbits(part, bitorder="little")[: i - block * BLOCK]
        return int(self._ranks[level][block]) + int(bits.sum())

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of this value on a level."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        """Id at place ``i``."""
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            ones = self._rank1(level, a), self._rank1(level, b)
            if token >> (self.levels - 1 - level) & 1:
                a, b = self.zeros[level] + ones[0], self.zeros[level] + ones[1]
            else:
                a, b = a - ones[0], b - ones[1]
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of an id at places a to b (exclusive; default: all)."""
        x, y = self._range(token, a, self.n if b is None else b)
        return y - x

    def locate(self, token: int) -> Iterator[int]:
        """Places of an id, ascending."""
        a, b = self._range(token, 0, self.n)
        for i in range(a, b):
            for level in reversed(range(self.levels)):
                bit = token >> (self.levels - 1 - level) & 1
                i = self._select(level, bit, i - self.zeros[level] if bit else i)
            yield i

    def decode(self) -> np.ndarray:
        """All ids, level by level from the last."""
        now = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            packed = [self._piece(level, p) for p in range(len(self.head["planes"][level]))]
            for p in range(len(packed)):
                self._pieces.pop((level, p))
            whole = np.concatenate(packed) if packed else np.zeros(0, np.uint8)
            bit = np.unpackbits(whole, bitorder="little", count=self.n).astype(bool)
            before = np.empty_like(now)
            zero, one = 0, self.zeros[level]
            for a in range(0, self.n, SPAN):  # places of a span stay in the processor's cache
                span, part = bit[a : a + SPAN], before[a : a + SPAN]
                places = np.flatnonzero(~span), np.flatnonzero(span)
                part[places[0]] = now[zero : zero + len(places[0])]
                part[places[1]] = now[one : one + len(places[1])] | now.dtype.type(1 << (self.levels - 1 - level))
                zero, one = zero + len(places[0]), one + len(places[1])
            now = before
        return now


def _give_back() -> None:
    """Return memory that earlier tasks of this worker freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it keeps what it has
        pass


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches, about ``STEP_BYTES`` at a time, and at most a batch more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= STEP_BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _write(folder: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        doc_ids, ids, sizes, shard = [], [], [], 0
        for part in _steps(batches):
            shard = part.column("shard")[0].as_py()
            coded, counts = encoder_of(tokenizer).encode(part.column("text").cast(pa.large_string()).combine_chunks())
            doc_ids += part.column("doc_id").to_pylist()
            ids.append(coded)
            sizes.append(counts)
        if doc_ids:
            counts = np.concatenate(sizes)
            write_file(f"{folder}/{shard:08d}.wm", WaveletMatrix.build(np.concatenate(ids), doc_ids, counts, shard))
            yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(doc_ids)], "tokens": [int(counts.sum())]})

    return run


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> str:
    """Encode every text, append the end id and write one file per shard; returns the folder.

    Documents are range-partitioned on doc_id and sorted in each shard (null ids first; equal ids by
    text), so file names ascend with the ids; rows that share an id may go on in the next shard. The number
    of shards follows from the bytes of text. Null and empty texts have the end id alone, repeated rows come
    as often as given, an empty table has no shard, and columns other than these two are not read.
    """
    small_batches(docs)
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-int(size) // shard_bytes))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Rows that share an id are cut by their text's beginning; whole texts would all be sampled for the ranges.
    dealt = dealt.repartitionByRange(shards, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    rows = dealt.withColumn("shard", F.spark_partition_id())
    rows.mapInArrow(_write(folder, tokenizer), "shard long, docs long, tokens long").write.format("noop").mode(
        "overwrite"
    ).save()
    return folder


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            matrix = WaveletMatrix(content.as_py())
            ids = matrix.decode().astype("<u4")
            doc_ids, sizes = matrix.documents()
            ends = np.cumsum(sizes)
            crcs = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([matrix.head["shard"]] * len(sizes), pa.int32()),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(ends - sizes),
                    pa.array(sizes),
                    pa.array(crcs, pa.int64()),
                ],
                ["shard", "doc_id", "offset", "n_tokens", "ids_crc32"],
            )


def read_shards(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    ``start`` counts the ids of all earlier documents: those of earlier shards are summed in two steps,
    a thousand shards at a time, so no task sees a row per document.
    """
    system = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not system.getFileSystem(spark._jsc.hadoopConfiguration()).exists(system):  # no document, no file
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("content")
    docs = materialize(
        files.mapInArrow(_read, "shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    )
    sizes = docs.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.expr("shard div 1000"))
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("group").agg(F.sum("n").alias("g")).withColumn("before", F.sum("g").over(earlier))
    inside = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("near", F.sum("n").over(inside)).join(groups, "group")
    starts = starts.select("shard", (F.coalesce("near", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("base"))
    return docs.join(starts, "shard").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )
