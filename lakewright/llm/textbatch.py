"""Vectorised word hashes of Arrow text batches.

A word is a maximal run of digits, letters a-z (A-Z count as a-z) and characters outside ASCII. All
functions work on the UTF-8 bytes of a whole batch at once; null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BATCH_ROWS = 1000
CHUNK_BYTES = 1 << 18  # a chunk's arrays fit the cache, and a worker needs some tens of megabytes
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_codes = np.arange(256)
_digit, _upper, _lower = ((_codes >= lo) & (_codes <= hi) for lo, hi in ((48, 57), (65, 90), (97, 122)))
IS_WORD = _digit | _upper | _lower | (_codes >= 128)
LOWER = (_codes + 32 * _upper).astype(np.uint8)
_tables = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def small_batches(df: DataFrame) -> None:
    """Let Arrow batches of this session hold ``BATCH_ROWS`` rows, unless it was set up for fewer.

    Whole texts are large rows; the default of 10,000 takes tens of megabytes several times over in each
    worker and its executor.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


def quoted(column: str) -> str:
    """A column's name for use in expressions, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``CHUNK_BYTES``: first row, bytes, offsets."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    pa.default_memory_pool().release_unused()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["up"]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Words(NamedTuple):
    hash: np.ndarray  # uint64 of each word
    first: np.ndarray  # index of the first word of each text, one more at the end
    start: np.ndarray  # byte offset of each word
    end: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of a run of texts, in order."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = IS_WORD[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start])
    return Words(hashes, np.searchsorted(start, offsets), start, end)


def shingles_of(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``size`` words of each text; a shorter text is one run."""
    n = len(words.hash)
    padded = np.concatenate([words.hash, np.zeros(size, np.uint64)])
    factors = [np.uint64((_BASE * (2 * j + 3)) & ((1 << 64) - 1) | 1) for j in range(size)]
    runs = sum((padded[j : j + n] * factors[j] for j in range(1, size)), padded[:n] * factors[0])
    runs = mix(runs)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            short = sum((words.hash[a + j : a + j + 1] * factors[j] for j in range(b - a)), np.array([b - a], np.uint64))
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of complete groups from batches sorted by ``key``; keeps at most one group back."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(key)
        last = values[-1].as_py()
        cut = batch.num_rows
        low, high = 0, cut  # first row of the last key
        while low < high:
            mid = (low + high) // 2
            if values[mid].as_py() == last:
                high = mid
            else:
                low = mid + 1
        if low:
            yield pa.Table.from_batches([*rest, batch.slice(0, low)])
            rest = [batch.slice(low)]
        elif rest and rest[-1].column(key)[-1].as_py() != last:
            yield pa.Table.from_batches(rest)
            rest = [batch]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)
