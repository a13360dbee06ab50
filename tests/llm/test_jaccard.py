import re
from collections import Counter, defaultdict

import pytest

from lakewright.llm.jaccard import choose_bands, jaccard_classes
from lakewright.sources.tables import table

SCHEMA = "doc_id long, text string"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def runs(text, size=5):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = [runs(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    links = [set() for _ in rows]
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g] if j != i)
        for j, n in shared.items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i].add(j)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(links):
            best = min([label[i], *(label[j] for j in others)])
            for j in [i, *others]:
                if label[j] != best:
                    label[j], changed = best, True
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[label[i]].append(doc)
    return Counter(
        (doc, min(ids[label[i]], default=None) if sets[i] else doc, len(links[i])) for i, (doc, _) in enumerate(rows)
    )


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    return Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(frame, **options).collect())


def test_bands_reach_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = choose_bands(threshold, 0.999, 256)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999
        assert bands * rows <= 256
    with pytest.raises(ValueError):
        choose_bands(0.2, 0.9999, 8)


def test_hard_rows(spark):
    base = [f"w{i}" for i in range(60)]
    changed = base.copy()
    changed[30] = "other"
    rows = [
        (5, " ".join(base)), (6, " ".join(changed)), (7, " ".join(base).upper()), (7, " ".join(base).upper()),
        (1, None), (2, ""), (3, "?! ..."), (4, "one two"), (9, "One, two!"), (10, "one"), (None, " ".join(base)),
        (None, None), (11, "é" * 70000), (12, "x " * 50000), (13, "x " * 40000),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:0]) == Counter()


def test_extra_columns_are_ignored(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", "k", 1)], SCHEMA + ", key string, row_hash int")
    assert [(r.doc_id, r.class_id) for r in jaccard_classes(frame).collect()] == [(1, 1)]


def test_blocks_do_not_matter(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        w = base.copy()
        for j in range(1 + i % 4):
            w[(17 * i + 41 * j) % 200] = f"z{i}"
        rows.append((i, " ".join(w)))
    expected = brute(rows)
    assert found(spark, rows) == expected
    assert found(spark, rows, block=8) == expected


def test_documents(spark, folder):
    docs = table(spark, folder.replace("0.001", "0.01"), "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(docs).collect())
    assert got == brute(rows)
