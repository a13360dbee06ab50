import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewright.llm import alignment
from lakewright.llm.alignment import Aligner
from lakewright.llm.queries import PIECES, QUERIES, tokenizer_path
from lakewright.sources.tables import table


@pytest.fixture(scope="module")
def aligner():
    return Aligner(tokenizer_path(), tokenizer_path(PIECES))


def brute_links(aligner, text):
    """(A ids, B ids, links in order, groups as text) of a text, by two pointers."""
    v = aligner.vocabulary
    raw = (" " + (text or "")).encode()
    a, b = v.a.encode(raw.decode(), add_special_tokens=False).ids, v.b.encode(text or "")
    joined = [b"".join(x[i] for i in ids) for x, ids in ((v.bytes_a, a), (v.bytes_b, b))]
    if not text or joined != [raw, raw]:
        return [], [], [], ""
    ends_a, ends_b = (np.cumsum([len(x[i]) for i in ids]).tolist() for x, ids in ((v.bytes_a, a), (v.bytes_b, b)))
    i = j = 0
    links, groups, left, right = [], [], [], []
    while i < len(a):
        links.append((a[i], b[j]))
        x, y = ends_a[i], ends_b[j]
        if x <= y:
            left.append(str(a[i]))
            i += 1
        if y <= x:
            right.append(str(b[j]))
            j += 1
        if x == y:
            groups.append(",".join(left) + "|" + ",".join(right))
            left, right = [], []
    return a, b, links, ";".join(groups)


def brute(aligner, docs):
    cut = [(doc, *brute_links(aligner, text)) for doc, text in docs]
    counts = Counter(pair for row in cut for pair in set(row[3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(
        (
            (
                doc,
                len(a),
                len(b),
                groups.count(";") + 1 if groups else 0,
                len(links),
                sum(counts[p] == best[p[0]] for p in links),
                sum(counts[p] for p in links),
                hashlib.sha256(groups.encode()).hexdigest() if groups else "",
            )
            for doc, a, b, links, groups in cut
        ),
        key=repr,
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t \u3000\x85\0.!'s1<|▁漢\ufeffﬁ", max_size=30), min_size=1, max_size=5))
def test_units_are_exact(texts):
    aligner = test_units_are_exact.__dict__.setdefault("aligner", Aligner(tokenizer_path(), tokenizer_path(PIECES)))
    for text, (facts, codes, times, digest) in zip(texts, aligner.align(texts)):
        a, b, links, groups = brute_links(aligner, text)
        assert facts.tolist() == [len(a), len(b), groups.count(";") + 1 if groups else 0, len(links)]
        assert dict(zip(codes.tolist(), times.tolist())) == Counter(x * aligner.n_b + y for x, y in links)
        assert digest == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_no_token_crosses_a_unit(aligner):
    """What units rest on: no piece of B goes on from another character to a space."""
    assert not [p for p in aligner.vocabulary.bytes_b if b" " in p.lstrip(b" ")]


def test_same_bytes(aligner):
    v = aligner.vocabulary
    at = np.flatnonzero(v.same >= 0)
    assert len(at) > 20000
    assert all(v.bytes_a[i] == v.bytes_b[v.same[i]] and not v.b.is_byte(int(v.same[i])) or len(v.bytes_a[i]) == 1 for i in at.tolist())


def test_aligner_forgets(monkeypatch, aligner):
    monkeypatch.setattr(alignment, "UNITS", 3)
    small = Aligner(tokenizer_path(), tokenizer_path(PIECES))
    for text in ["one two three four", "two strangeish words", "one more", "  spaced  out "] * 2:
        facts, codes, times, digest = next(small.align([text]))
        assert digest == hashlib.sha256(brute_links(aligner, text)[3].encode()).hexdigest()


def test_documents(spark, folder, aligner):
    docs = table(spark, folder, "documents").select("doc_id", "text").collect()
    got = QUERIES["op11_tokenizer_alignment"](spark, folder)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(aligner, docs)


def test_hard_rows(spark, aligner):
    docs = [(1, "unbelievable thinkingly"), (1, "unbelievable thinkingly"), (1, None), (2, ""), (None, "thinkingly so")]
    docs += [(3, "▁ is not a space"), (4, "<|endoftext|><s>"), (5, "word unbelievably " * 30000), (6, "x" * 20000), (7, " ")]
    docs += [(9, "the same hot text")] * 20
    frame = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], "doc_id long, text string, `a b:c` string, codes int")
    got = alignment.align(frame, tokenizer_path(), tokenizer_path(PIECES)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(aligner, docs)
    assert alignment.align(frame.limit(0), tokenizer_path(), tokenizer_path(PIECES)).count() == 0
    nothing = frame.where("doc_id = 2")
    assert [r.n_links for r in alignment.align(nothing, tokenizer_path(), tokenizer_path(PIECES)).collect()] == [0]
