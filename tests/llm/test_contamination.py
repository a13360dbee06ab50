import re

import pytest
from pyspark.sql import functions as F

from lakewright.llm.contamination import phrase_hits, proximity_matches
from lakewright.sources.tables import table

PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(text, items, size=10):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(size, len(b))
        windows = {tuple(b[s : s + n]) for s in range(max(len(b) - size, 0) + 1)} if b else set()
        for p in range(len(w) - n + 1 if n else 0):
            if tuple(w[p : p + n]) in windows:
                hit.update(range(p, p + n))
                found.add(item)
    return len(w), len(hit), found - {None}


def check(spark, docs, items):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("x")).withColumn("offset", F.lit(1)).withColumn("_k1", F.lit("k"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    got = phrase_hits(frame, bench).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, set(r["items"])) == brute(r.text, items), r.text
        assert r.offset == 1 and r._k1 == "k"


def test_hard_rows(spark):
    docs = [
        (1, None), (2, ""), (3, "?!"), (4, PASSAGE), (4, PASSAGE), (4, PASSAGE.upper() + "!"), (None, f"x {PASSAGE} y {PASSAGE}"),
        (5, PASSAGE[:44]), (6, "one two three four five six seven eight nine ten twelve"), (7, "a a a a a a a a a a a a"), (8, "É é Ü one"),
        (9, "short item"), (10, "so a short item, and a Short Item"), (11, "É é"), (12, "é é"), (13, "the " * 60000 + PASSAGE),
        (14, "-one-two-three-four-five-six-seven-eight-nine-ten-"), (15, "ten eleven twelve"),
    ]
    items = [
        (20, PASSAGE), (3, PASSAGE), (21, "short item"), (22, "a a a a a a a a a a a"), (23, None), (24, "..."), (None, "É é"),
        (25, "one two three four five six seven eight nine ten other words"), (20, "y one two three"), (26, "unknown words"),
    ]
    check(spark, docs, items)
    check(spark, docs, items[:0])
    check(spark, docs[:0], items)
    check(spark, docs, [(1, None)])


def test_random_words(spark):
    import random

    random.seed(4)
    text = lambda n, v: " ".join(random.choice(v) for _ in range(n))
    few, many = list("ab"), [f"w{i}" for i in range(30)]
    items = [(i, text(random.randint(1, 25), random.choice([few, many]))) for i in range(12)]
    docs = []
    for i in range(40):
        parts = [text(random.randint(0, 20), random.choice([few, many])) for _ in range(3)]
        at = random.randrange(3)
        body = words(random.choice(items)[1])
        cut = random.randint(0, 3)
        parts[at] += " " + " ".join(body[cut:])
        docs.append((i, " ".join(parts)))
    check(spark, docs, items)


@pytest.mark.parametrize("slop,expected", [(0, {4}), (1, {4, 5}), (3, {4, 5, 6})])
def test_proximity(spark, slop, expected):
    docs = [(4, PASSAGE), (5, PASSAGE.replace("six", "x six")), (6, PASSAGE.replace("six", "x y z six")), (7, "one two")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(PASSAGE.split()[:10]))], "item_id long, text string")
    got = proximity_matches(docs, bench, slop, anchors=10).collect()
    assert {r.doc_id for r in got} == expected


def test_documents(spark, folder):
    docs, bench = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    for r in phrase_hits(docs, bench).collect():
        assert (r.n_words, r.n_hit, set(r["items"])) == brute(r.text, items)
