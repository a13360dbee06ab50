"""FM-index of a set of word sequences, searched for many patterns at once.

The sequences stand one after the other, a separator after each. Their suffixes are sorted by prefix doubling;
the word before each suffix, in that order, is the transform that is kept, as a wavelet matrix over the words'
numbers. One step of backward search puts a word before each pattern and moves its interval of suffixes, with
two ranks a level. Two bit vectors mark where neighbouring suffixes differ within ``window`` words and within
one word less, so an interval is widened to a shorter match without another search, as matching statistics
need it. Every group of suffixes that share ``window`` words keeps the least value of the sequences it is in.
"""

from __future__ import annotations

import io

import numpy as np
import zstandard

MAGIC = b"LWFM\x01"
NOWHERE = np.iinfo(np.int64).max


class BitVector:
    """Bits with the number of ones before each 64-bit word."""

    def __init__(self, packed: np.ndarray, n: int):
        self.n = n
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    @staticmethod
    def of(bits: np.ndarray) -> BitVector:
        return BitVector(np.packbits(bits, bitorder="little"), len(bits))

    def packed(self) -> np.ndarray:
        return self.words.view(np.uint8)[: -(-self.n // 8)]

    def ones(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def places(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.packed(), bitorder="little", count=self.n))


def _suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each suffix's rank by its first ``depth`` words, a power of two."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    at_depth = rank
    size = 1
    while True:
        if size == depth:
            at_depth = rank
        after = np.zeros(n, np.int64)
        after[: max(n - size, 0)] = rank[size:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        ordered = key[order]
        new[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        rank, size = new, size * 2
        if size > depth and rank[order[-1]] == n - 1 or size > 2 * n + depth:
            return order, at_depth


def _differs(order: np.ndarray, rank: np.ndarray, depth: int, length: int) -> np.ndarray:
    """Where a suffix and the one before it differ within ``length`` words, from ranks by ``depth`` words."""
    padded = np.concatenate([rank, np.full(length, -1)])
    first, last = padded[order], padded[order + (length - depth)]
    return np.concatenate([[True], (first[1:] != first[:-1]) | (last[1:] != last[:-1])])


class FMIndex:
    """Words, transform and least values; see the module."""

    def __init__(self, words: list[bytes], n: int, window: int, planes: list[BitVector], near, far, least: np.ndarray):
        self.words, self.n, self.window, self.planes = words, n, window, planes
        self.near, self.far, self.least = near, far, least
        self.number = {w: i + 1 for i, w in enumerate(words)}
        self.zeros = [n - p.ones() for p in planes]
        symbols = np.arange(len(words) + 2)
        self.base = self._trace(symbols, np.zeros(len(symbols), np.int64))
        ends = self._trace(symbols, np.full(len(symbols), n))
        counts = ends - self.base
        counts[-1] = 0
        self.first = np.cumsum(counts) - counts
        starts = near.places()
        self._near = np.concatenate([starts, [n]])

    @staticmethod
    def build(pieces: list[list[bytes]], values: np.ndarray, window: int) -> FMIndex:
        """Index of word sequences, with a value each."""
        words = sorted({w for p in pieces for w in p})
        number = {w: i + 1 for i, w in enumerate(words)}
        text = np.fromiter((x for p in pieces for x in (*map(number.__getitem__, p), 0)), np.int64)
        owner = np.repeat(values, [len(p) + 1 for p in pieces])
        depth = 1 << (window - 1).bit_length() - 1 if window > 1 else 1
        depth = depth if depth <= window - 1 else depth // 2
        order, rank = _suffixes(text, depth)
        far = _differs(order, rank, depth, window)
        near = _differs(order, rank, depth, window - 1)
        least = np.minimum.reduceat(owner[order], np.flatnonzero(far))
        now = text[order - 1]
        planes = []
        levels = max(1, len(words).bit_length())
        for level in reversed(range(levels)):
            bit = now >> level & 1 == 1
            planes.append(BitVector.of(bit))
            now = np.concatenate([now[~bit], now[bit]])
        return FMIndex(words, len(text), window, planes, BitVector.of(near), BitVector.of(far), least)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        planes = np.concatenate([p.packed() for p in (*self.planes, self.near, self.far)])
        head = np.array([self.n, self.window, len(self.planes), len(self.least)], np.int64)
        for part in (head.tobytes(), planes.tobytes(), self.least.astype(np.int64).tobytes(), b"\n".join(self.words)):
            packed = zstandard.ZstdCompressor(level=1).compress(part)
            out.write(len(packed).to_bytes(8, "little") + packed)
        return MAGIC + out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> FMIndex:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not an index")
        at, parts = len(MAGIC), []
        while at < len(data):
            size = int.from_bytes(data[at : at + 8], "little")
            parts.append(zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + size]))
            at += 8 + size
        n, window, levels, _ = np.frombuffer(parts[0], np.int64).tolist()
        planes = np.frombuffer(parts[1], np.uint8).reshape(levels + 2, -1)
        *planes, near, far = (BitVector(p, n) for p in planes)
        words = parts[3].split(b"\n") if parts[3] else []
        return FMIndex(words, n, window, planes, near, far, np.frombuffer(parts[2], np.int64))

    def _trace(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of prefixes of the transform, level by level along each symbol's bits."""
        for level, plane in enumerate(self.planes):
            ones = plane.rank(at)
            bit = symbols >> (len(self.planes) - 1 - level) & 1 == 1
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return at

    def _before(self, symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one word put before each."""
        both = self._trace(np.concatenate([symbols, symbols]), np.concatenate([a, b]))
        shift = self.first[symbols] - self.base[symbols]
        return shift + both[: len(a)], shift + both[len(a) :]

    def search(self, pieces: list[list[bytes]]) -> list[np.ndarray]:
        """Per sequence, for each of its windows: the least value it is indexed under, or ``NOWHERE``.

        The matching statistics of each sequence from its end, cut at ``window`` words: a match grows to the
        left; at full length it is reported and loses its last word. Where it cannot grow, no window holds
        the word that stopped it and the match's last word, and the search goes on from the word before that.
        """
        window, unknown = self.window, len(self.words) + 1
        sizes = np.array(list(map(len, pieces)), np.int64)
        offset = np.cumsum(sizes) - sizes
        number = self.number
        text = np.fromiter((number.get(w, unknown) for p in pieces for w in p), np.int64, int(sizes.sum()))
        out = np.full(len(text), NOWHERE, np.int64)
        live = np.flatnonzero(sizes >= window)
        at, length = sizes[live] - 1, np.zeros(len(live), np.int64)
        a, b = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        while len(live):
            symbol = text[offset[live] + at]
            x, y = self._before(np.where(symbol == unknown, 0, symbol), a, b)
            found = (x < y) & (symbol != unknown)
            full = found & (length == window - 1)
            out[(offset[live] + at)[full]] = self.least[self.far.rank(x[full] + 1) - 1]
            group = self.near.rank(np.minimum(x, self.n - 1) + 1)
            low, high = self._near[group - 1], self._near[group]
            restart = ~found
            a = np.where(restart, 0, np.where(full, low, x))
            b = np.where(restart, self.n, np.where(full, high, y))
            at = np.where(restart, at + np.maximum(length - 1, -1), at - 1)
            length = np.where(restart, 0, np.where(full, window - 1, length + 1))
            more = at + length >= window - 1
            more &= at >= 0
            if not more.all():
                live, at, length, a, b = live[more], at[more], length[more], a[more], b[more]
        return [out[o : o + max(0, n - window + 1)] for o, n in zip(offset.tolist(), sizes.tolist())]
