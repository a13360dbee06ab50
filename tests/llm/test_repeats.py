import hashlib
import random
import re

import numpy as np
import pytest

from lakewright.llm import repeats
from lakewright.llm.fm_index import NOWHERE, FMIndex
from lakewright.llm.repeats import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    low = {}
    split = [(doc, WORD.findall(text or "")) for doc, text in docs]
    for doc, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if doc is not None:
                low[key] = min(low.get(key, doc), doc)
    out = []
    for doc, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if doc is not None and low[tuple(words[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, docs):
    rows = [(d, t, "x", [1]) for d, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, `my col` string, words array<int>")


def result(spark, docs, **how):
    return sorted(map(tuple, remove_repeats(frame(spark, docs), **how).collect()), key=repr)


@pytest.mark.parametrize("seed", range(40))
def test_index_against_brute_force(seed):
    draw = random.Random(seed)
    window, kinds = draw.choice([2, 3, 4, 5, 8, 9, 16, 17]), draw.choice([1, 2, 3, 10])

    def piece():
        return [b"w%d" % draw.randrange(kinds) for _ in range(draw.randint(1, 30))]

    pieces = [piece() for _ in range(draw.randint(1, 12))]
    values = np.array([draw.randrange(100) for _ in pieces])
    index = FMIndex.from_bytes(FMIndex.build(pieces, values, window).to_bytes())
    least = {}
    for p, v in zip(pieces, values.tolist()):
        for i in range(len(p) - window + 1):
            key = tuple(p[i : i + window])
            least[key] = min(least.get(key, v), v)
    asked = pieces + [piece() for _ in range(10)] + [[b"zz"] * 20, [b"w0"] * 6 + [b"q"] + [b"w0"] * 20, []]
    for words, found in zip(asked, index.search(asked)):
        assert found.tolist() == [least.get(tuple(words[i : i + window]), NOWHERE) for i in range(len(words) - window + 1)]
    with pytest.raises(ValueError):
        FMIndex.from_bytes(b"nothing of this kind")


def test_passages(spark):
    """Shared passages, near copies, exact copies, repeats inside one text; ids out of order, many shards."""
    draw = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(400)]
    make = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    shared = [make(n) for n in (12, 20, 49, 50, 51, 200)]
    docs = []
    for i in draw.sample(range(-40, 200), 120):
        words = make(draw.randint(0, 60))
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(shared)
            a = draw.randint(0, len(p) // 3)
            words += p[a:] + make(draw.randint(0, 30))
        docs.append((i, draw.choice([" ", "\n", " \t "]).join(words)))
    docs += [(300 + i, docs[0][1]) for i in range(5)] + [(400, " ".join(["again"] * 500)), (401, " ".join(["again"] * 90))]
    docs += [(402, docs[3][1]), (402, docs[4][1]), (None, docs[3][1]), (None, None), (403, ""), (404, "\u3000 \x85 word")]
    expected = {w: brute(docs, w) for w in (12, 50)}
    assert result(spark, docs) == expected[50]
    assert result(spark, docs, window=12, shard_words=500) == expected[12]
    assert result(spark, docs, window=12, hot=2, shard_words=2000) == expected[12]


def test_hot_line(spark):
    """A line that a third of all rows hold, in other text each, and a text that repeats itself."""
    draw = random.Random(6)
    line = " ".join(f"line{i}" for i in range(11))
    docs = [(i, " ".join(f"a{draw.randrange(50)}" for _ in range(draw.randint(5, 40))) + " " + line + f" end{i % 4} " * 12) for i in range(60)]
    assert result(spark, docs, window=15, hot=5) == brute(docs, 15)
    assert result(spark, docs, window=15) == brute(docs, 15)


def test_long_and_empty(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 1000)
    long = " ".join(f"n{i % 7000}" for i in range(60000))
    docs = [(2, long), (1, "x" * 5000 + " " + " ".join(f"n{i}" for i in range(40, 300))), (3, long)]
    assert result(spark, docs) == brute(docs, 50)
    assert result(spark, []) == []
    assert result(spark, [(1, None), (2, "short")]) == brute([(1, None), (2, "short")], 50)
