"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of aligned id pairs.

Both tokenizers cut a document's bytes into tokens. Offsets where tokens of both end cut it into groups; two
tokens whose bytes overlap are linked. Where a token of A has the bytes of one token of B, the pair needs no
key: an array indexed by A's ids names the B id, and how many documents hold such a pair is one number per
A id, so those counts are vectors of the vocabulary's length that are added up. Only the other pairs, from
groups that the tokenizers cut differently, are rows of a shuffle.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.textbatch import small_batches, text_bytes
from lakewright.llm.wavelet import _RISKY, _plain_rows, pieces_of
from lakewright.operators.skew import lookup
from lakewright.session import materialize

UNITS = 250_000  # units of text that a worker remembers
UNIT_BYTES = 16 << 20  # bytes of text in them
JOINED = 500  # new units encoded as one text
STEP = 64  # documents aligned at once
_WORD_START = "▁"


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, then U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """The bytes of every id of both tokenizers, and for each A id the B id of the same bytes (-1: none)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        words = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for word, i in words.items():
            if all(c in alphabet for c in word):
                self.bytes_a[i] = bytes(alphabet[c] for c in word)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        by_bytes = {}
        for i, piece in sorted(enumerate(self.bytes_b), key=lambda p: self.b.is_byte(p[0])):
            by_bytes.setdefault(piece, i)  # a piece comes before a byte token of the same bytes
        self.same = np.array([by_bytes.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace(_WORD_START, " ").encode()


class Aligner:
    """Aligns texts unit by unit; a unit is a space and what follows it up to the next safe space.

    No token of either tokenizer crosses from a visible character to a space, so units are cut and linked on
    their own, and what is known of a unit serves all its occurrences. A full memory starts anew.
    """

    def __init__(self, path_a: str, path_b: str):
        self.vocabulary = Vocabularies(path_a, path_b)
        self.n_b = len(self.vocabulary.bytes_b)
        self.text_a = [str(i) for i in range(len(self.vocabulary.bytes_a))]
        self.text_b = [str(i) for i in range(self.n_b)]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.facts = np.zeros((0, 6), np.int64)  # A ids, B ids, groups, links, first link, fits
        self.codes = np.zeros(0, np.int64)
        self.groups: list[str] = []

    def _alone(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of both tokenizers, tokens of each unit and whether their bytes are the unit's; one text per unit."""
        v = self.vocabulary
        whole = [" " + u for u in units]
        a = [e.ids for e in v.a.encode_batch_fast(whole, add_special_tokens=False)]
        b = v.b.encode(units, num_threads=1)
        if "" in units:  # a lone space: an empty text would get no token
            b[units.index("")] = [v.b.piece_to_id(_WORD_START)]
        fits = np.ones(len(units), np.int64)
        for i, (text, x, y) in enumerate(zip(whole, a, b)):
            raw = text.encode()
            if b"".join([v.bytes_b[t] for t in y]) != raw or b"".join([v.bytes_a[t] for t in x]) != raw:
                fits[i] = 0
                a[i] = b[i] = []
        counts = (np.array(list(map(len, x)), np.int64) for x in (a, b))
        return *(np.array([t for ids in x for t in ids], np.int64) for x in (a, b)), *counts, fits

    def _together(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """As ``_alone`` of units that end in a safe character: encoded as one text, cut at the bytes where units end."""
        v = self.vocabulary
        text = " ".join(units)
        a = v.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = v.b.encode(text)
        raw = b" " + text.encode()
        if b"".join([v.bytes_a[t] for t in a]) != raw or b"".join([v.bytes_b[t] for t in b]) != raw:
            return self._alone(units)
        wanted = np.cumsum([1 + len(u.encode()) for u in units])
        ids, counts = [np.array(x, np.int64) for x in (a, b)], []
        for x, size in zip(ids, (v.size_a, v.size_b)):
            ends = np.cumsum(size[x])
            cut = np.searchsorted(ends, wanted)
            if (ends[cut] != wanted).any():
                return self._alone(units)
            counts.append(np.diff(cut, prepend=-1))
        return *ids, *counts, np.ones(len(units), np.int64)

    def _learn(self, safe: list[str], others: list[str]) -> None:
        runs = [self._together(safe[i : i + JOINED]) for i in range(0, len(safe), JOINED)]
        runs += [self._alone(others)] if others else []
        ids_a, ids_b, count_a, count_b, fits = (np.concatenate(x) for x in zip(*runs))
        v = self.vocabulary
        ends_a, ends_b = np.cumsum(v.size_a[ids_a]), np.cumsum(v.size_b[ids_b])
        at_a, at_b = (np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, bool) for _ in range(2))
        at_a[ends_a] = at_b[ends_b] = True
        cuts, common = np.flatnonzero(at_a | at_b), np.flatnonzero(at_a & at_b)
        # Between two neighbouring cuts lies the overlap of exactly one token of each side.
        codes = ids_a[np.searchsorted(ends_a, cuts)] * self.n_b + ids_b[np.searchsorted(ends_b, cuts)]
        stop = np.concatenate([[0], ends_a])[np.cumsum(count_a)]  # byte at which each unit ends
        links, groups = (np.diff(np.searchsorted(x, stop, "right"), prepend=0) for x in (cuts, common))
        first = len(self.codes) + np.cumsum(links) - links
        self.facts = np.concatenate([self.facts, np.column_stack([count_a, count_b, groups, links, first, fits])])
        self.codes = np.concatenate([self.codes, codes])
        to_a, to_b = np.searchsorted(ends_a, common, "right").tolist(), np.searchsorted(ends_b, common, "right").tolist()
        from_a, from_b = [0, *to_a[:-1]], [0, *to_b[:-1]]
        text_a, text_b = [self.text_a[t] for t in ids_a.tolist()], [self.text_b[t] for t in ids_b.tolist()]
        written = [
            f"{text_a[p]}|{text_b[q]}" if s - p == 1 == t - q else f"{','.join(text_a[p:s])}|{','.join(text_b[q:t])}"
            for p, s, q, t in zip(from_a, to_a, from_b, to_b)
        ]
        at = np.cumsum(groups).tolist()
        self.groups += [";".join(written[p:q]) for p, q in zip([0, *at[:-1]], at)]

    def _numbers(self, units: list[str]) -> np.ndarray:
        known = self.known
        new = list(dict.fromkeys([u for u in units if u not in known]))
        if new:
            safe = [u for u in new if u and not _RISKY.match(u[-1])]
            others = [u for u in new if not u or _RISKY.match(u[-1])]
            for u in (*safe, *others):
                known[u] = len(known)
            self.bytes += sum(map(len, new))
            self._learn(safe, others)
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """Per text: (A ids, B ids, groups, links), pair codes, links of each code, digest of the groups."""
        if len(self.known) > UNITS or self.bytes > UNIT_BYTES:
            self._clear()
        spaced = [" " + text if text else "" for text in texts]
        plain = _plain_rows(*text_bytes(pa.array([text[1:] for text in spaced], pa.string())))
        parts: list[list[str]] = []
        for text, simple in zip(spaced, plain.tolist()):
            if simple:
                parts.append(text.split(" ")[1:])
            else:
                head, rest = pieces_of(text)
                parts.append([head[1:], *rest])
        numbers = self._numbers([u for units in parts for u in units])
        at = 0
        for units in parts:
            mine = numbers[at : at + len(units)]
            at += len(units)
            facts = self.facts[mine]
            if not len(mine) or not facts[:, 5].all():
                yield np.zeros(4, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), ""
                continue
            n, first = facts[:, 3], facts[:, 4]
            place = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
            codes, times = np.unique(self.codes[place], return_counts=True)
            groups = ";".join([self.groups[i] for i in mine.tolist()])
            yield facts[:, :4].sum(0), codes, times, hashlib.sha256(groups.encode()).hexdigest()


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(path_a: str, path_b: str) -> Aligner:
    """The aligner of this worker, kept from task to task with the units it remembers."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


_CODED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "same_ids array<int>, same_links array<int>, codes array<long>, code_links array<int>"
)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def _code(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            aligner = aligner_of(path_a, path_b)
            same, n_b = aligner.vocabulary.same, aligner.n_b
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                totals, digests, lists = [], [], ([], [], [], [])
                for facts, codes, times, digest in aligner.align(part.column(1).to_pylist()):
                    totals.append(facts)
                    digests.append(digest)
                    own = same[codes // n_b] == codes % n_b
                    for kept, values in zip(lists, (codes[own] // n_b, times[own], codes[~own], times[~own])):
                        kept.append(values)
                kinds = pa.int32(), pa.int32(), pa.int64(), pa.int32()
                columns = [part.column(0), *map(pa.array, np.array(totals).T.copy()), pa.array(digests, pa.string())]
                columns += [_lists(x, kind) for x, kind in zip(lists, kinds)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _CODED.split(", ")])

    return run


def _add_up(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["a", "n"])

    return run


def _score(counts: np.ndarray, is_best: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, links = batch.column("same_ids"), batch.column("same_links")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ids.offsets.to_numpy()))
            ids, links = (x.flatten().to_numpy(zero_copy_only=False) for x in (ids, links))
            total, best = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            np.add.at(total, owner, counts[ids] * links)
            np.add.at(best, owner, is_best[ids] * links)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(best), pa.array(total)], ["row", "n", "s"])

    return run


def _vector(rows, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for a, n in rows:
        out[a] = n
    return out


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Aligned tokens of every document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a`` is a byte-level vocabulary, ``path_b`` a piece model that adds a space; A encodes a space and
    the text. The count of an id pair is the number of rows that hold it linked; ``count_sum`` adds the counts
    of a document's links, ``n_best`` is the number of its links whose count is the highest of their A id, ties
    included. Null and empty texts, and texts whose joined token bytes differ from space and text in either
    tokenizer, have zeros and the digest ''. Repeated rows count each time and null ids are kept. Texts of any
    length are cut at spaces into units; a unit without any space is encoded at once. An empty table gives no
    row. Other columns are neither read nor returned.
    """
    small_batches(docs)
    spark = docs.sparkSession
    vocabulary = Vocabularies(path_a, path_b)
    size, n_b = len(vocabulary.bytes_a), len(vocabulary.bytes_b)
    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_code(path_a, path_b), _CODED)
    coded = materialize(coded.withColumn("row", F.monotonically_increasing_id()))  # written, so rows keep their number
    same = coded.select("same_ids").mapInArrow(_add_up(size), "a int, n long").groupBy("a").agg(F.sum("n"))
    same = _vector(same.collect(), size)  # one number per id of A
    pairs = materialize(coded.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")))
    most = pairs.groupBy(F.expr(f"int(code div {n_b})").alias("a")).agg(F.max("n"))
    best = np.maximum(same, _vector(most.collect(), size))
    held = np.flatnonzero(best)
    tops = spark.createDataFrame(list(zip(held.tolist(), best[held].tolist())), "a int, top long")
    pairs = pairs.withColumn("a", F.expr(f"int(code div {n_b})")).join(F.broadcast(tops), "a")  # a row per id of A
    pairs = pairs.select("code", "n", (F.col("n") == F.col("top")).alias("is_best"))
    links = coded.select("row", F.explode(F.arrays_zip("codes", "code_links")).alias("l"))
    links = lookup(links.select("row", "l.codes", "l.code_links").toDF("row", "code", "links"), pairs, ["code"], "inner")
    others = links.select("row", F.expr("if(is_best, links, 0L)").alias("n"), (F.col("n") * F.col("links")).alias("s"))
    scored = coded.select("row", "same_ids", "same_links").mapInArrow(_score(same, same == best), "row long, n long, s long")
    both = scored.unionByName(others.groupBy("row").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    sums = both.groupBy("row").agg(F.sum("n").alias("n_best"), F.sum("s").alias("count_sum"))
    return coded.join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
