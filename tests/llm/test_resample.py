import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewright.llm import resample
from lakewright.llm.resample import Scan, bucket_counts, gains, shifted

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_buckets(text):
    words = brute_words(text)
    return sorted(zlib.crc32(f.encode()) % 10000 for f in words + [" ".join(p) for p in zip(words, words[1:])])


def scanned(texts):
    scan, out = Scan(), [[] for _ in texts]
    for words, owners in resample._blocks(pa.array(texts, pa.string())):
        buckets, held_by = scan.block(words, owners)
        for i in np.unique(held_by):
            out[i] += buckets[held_by == i].tolist()
    return [sorted(b) for b in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="abZ9 \n\t.é漢\x85\u2003-", max_size=60), max_size=6))
def test_buckets_of_any_text(texts):
    assert scanned(texts) == [brute_buckets(t) for t in texts]


def test_buckets_over_blocks(monkeypatch):
    texts = ["one two " * 500, None, "x" * 3000 + " y", "Ä" * 900, "tail"]
    for size in (64, 1000, 1 << 18):
        monkeypatch.setattr(resample, "BLOCK_BYTES", size)
        assert scanned(texts) == [brute_buckets(t) for t in texts]


def test_shifts():
    for n in (0, 1, 63, 64, 1000, 70000):
        crc = np.array([zlib.crc32(b"head")], np.uint32)
        tail = b"t" * n
        assert int(shifted(crc, np.array([n]))[0]) ^ zlib.crc32(tail) == zlib.crc32(b"head" + tail)


def brute(docs, target, percent=25):
    count = lambda texts: np.bincount([b for t in texts for b in brute_buckets(t)], minlength=10000).tolist()
    s, t = count([x for _, x in docs]), count(target)
    total, wanted = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (total + 10000) / ((a + 1) * (wanted + 10000)))) for a, b in zip(s, t)]
    rows = []
    for doc, text in docs:
        found = brute_buckets(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(brute_words(text)), len(found), weight, score, None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for i, row in enumerate(able[: len(able) * percent // 100]):
        row[5] = i + 1
    return sorted(map(tuple, rows), key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "s", 1) for d, t in docs], "doc_id long, text string, `my rank` string, score int")


def test_draw(spark):
    docs = [(i, f"Common words in text {i % 7} " * (i % 9) + "spe cial " * (i % 3)) for i in range(60)]
    docs += [(5, docs[5][1]), (5, None), (None, "no id " * 12), (None, ""), (70, "é" * 5000), (71, "very long " * 60000)]
    target = ["special spe cial words", "", None, "Common words"]
    frames = frame(spark, docs), spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted(map(tuple, resample.resample(*frames).collect()), key=repr)
    assert got == brute(docs, target)
    none = frames[1].limit(0)
    assert sorted(map(tuple, resample.resample(frames[0], none, percent=50).collect()), key=repr) == brute(docs, [], 50)
    assert resample.resample(frames[0].limit(0), frames[1]).count() == 0
    assert bucket_counts(none).sum() == 0 and gains(bucket_counts(none), bucket_counts(none)).max() == 0


def test_draw_of_equal_scores(spark):
    """A third of all rows share one id and text; ranks stay distinct."""
    docs = [(1, "same words over and over " * 5)] * 40 + [(i, f"other {i} words " * 9) for i in range(2, 82)]
    rows = resample.resample(frame(spark, docs), spark.createDataFrame([("same words",)], "text string")).collect()
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 31))
    assert sorted(map(tuple, rows), key=repr) == brute(docs, ["same words"])
