import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakewright.llm import privacy
from lakewright.llm.queries import op6
from lakewright.sources.tables import table


def digits(value):
    return re.sub("[^0-9]", "", value)


def luhn(value):
    total = 0
    for i, c in enumerate(reversed(value)):
        total += int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4)
    return total % 10 == 0


PATTERNS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
]


def brute(text):
    return [
        (k, m.start(), m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if ok(m[0])
    ]


def spans_of(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = frame.select("i", privacy.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()
    return [[(s.kind, s.start, s.end) for s in r.s] for r in sorted(rows, key=lambda r: r.i)]


def test_base_spans_of_generated_texts(spark):
    texts = []

    @settings(max_examples=600, deadline=None, database=None)
    @given(
        st.lists(
            st.sampled_from(
                ["a", "b_", "@", ".", "x.com", "-", " ", "+", "1", "23", "4111 1111 1111 1111", "999", "255.1.1", "(", ")", "é", "\n", "%"]
            ),
            max_size=14,
        )
    )
    def gather(parts):
        texts.append("".join(parts))

    gather()
    assert spans_of(spark, texts) == [brute(t) for t in texts]


def test_base_spans_of_hard_texts(spark):
    texts = [
        None, "", "a@b.c_d@e.f", "..a@b.c..d@e.f.", "x" * 60000 + "@", "1" * 60000, "1 " * 30000, "+1" + "(" * 30000, "é" * 300 + " me@x.org",
        "0001.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 99999999999999.1.1.1", "4111-1111-1111-1111 4111 1111 1111 1112", "+1 (449) 555-4182 +123 45",
        "\U0001f600 a@b.co", "12 4111 1111 1111 1111", "5 - 4111 1111 1111 1111",
    ]
    assert spans_of(spark, texts) == [brute(t) for t in texts]


def test_documents(spark, folder):
    rows = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    for r in op6(spark, folder).collect():
        expected = brute(rows[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for k, _, _ in expected) for j in range(4))
        listed = ",".join(f"{privacy.KINDS[k]}:{a}:{b}" for k, a, b in expected)
        assert r.spans == listed or r.spans.startswith(listed)


def brute_entities(kind, value):
    if kind == 0:
        return [(0, value.lower()), ("domain", value.lower().rpartition("@")[2])]
    if kind == 1:
        return [(1, value), ("network", ".".join(value.split(".")[:3]))]
    return [(kind, digits(value)), (kind, "range", digits(value)[:-4])]


def brute_terms(texts, generalise_at=0.8, prior=2.0, support=2):
    """Score of each disclosing term by plain counting over distinct texts."""
    texts = sorted(set(texts))
    entities, pairs, words = {}, {}, {}
    for t in texts:
        for w in set(re.findall(r"[^\W\d_]+", t.lower())):
            words.setdefault(w, set()).add(t)
        beside = set(re.findall(r"[^\W\d_]+", re.sub(PATTERNS[0][0], " ", t).lower()))
        for k, a, b in brute(t):
            for e in brute_entities(k, t[a:b]):
                entities.setdefault(e, set()).add(t)
                for w in beside:
                    pairs.setdefault((e, w), set()).add(t)
    out = {}
    for (e, w), both in pairs.items():
        if len(entities[e]) >= support and len(both) >= support:
            p = len(entities[e]) / len(texts)
            score = math.log((len(both) + prior * p) / (len(words[w]) + prior) / p) / -math.log(p) if p < 1 else 0.0
            if score >= generalise_at:
                out[w] = max(score, out.get(w, 0))
    return out


def check_terms(spark, rows):
    """The registered mode against plain counting; returns the disclosing terms."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_terms([t or "" for _, t in rows])
    found = privacy.find(frame).collect()
    for r in found:
        base = [(a, b) for _, a, b in brute(r.text)]
        wanted = [m for m in re.finditer(r"[^\W\d_]+", r.text) if m[0].lower() in expected]
        wanted = [m for m in wanted if not any(a < m.end() and m.start() < b for a, b in base)]
        spans = [s for s in r.spans if s.kind == 4]
        assert [(s.start, s.end) for s in spans] == [m.span() for m in wanted]
        assert [s.label for s in spans] == ["" if expected[m[0].lower()] >= 0.9 else "[TERM]" for m in wanted]
    return set(expected), found


PLAIN = [f"nothing here but the words number {chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)]


def test_disclosing_terms(spark):
    told = [
        "Dr Zarquon wrote from z@mail.org about the words", "the Zarquon address z@mail.org is here", "Zarquon, Zarquon! z@MAIL.org nothing",
        "zarquon z@mail.org words", "the words of z@mail.org", "other t@x.org words", "Zarquon alone without address but words",
    ]
    terms, found = check_terms(spark, [(i, t) for i, t in enumerate([*PLAIN, *told, told[0], None])])
    assert terms == {"zarquon"}
    clean = {r.text for r in privacy.sanitise(spark.createDataFrame(found)).collect()}
    assert any(t.startswith("Dr ") and "[EMAIL] about the words" in t and "Zarquon" not in t for t in clean)
    assert not any("Zarquon" in t for t in clean) and "other [EMAIL] words" in clean


def test_names_of_any_length_and_script(spark):
    """Names planted beside addresses: short ones, other scripts, far away in the text, addresses of one domain each."""
    names = ["Bo", "李明", "Zarquon", "Ærø", "Ivanovic"]
    rows = list(PLAIN)
    for k, name in enumerate(names):
        rows += [f"{name} of {'the words ' * (40 if i % 2 else 1)} person{i}@home{k}.example.org" for i in range(6)]
        rows += [f"call {name} {'but the words ' * i} at +49 30 5550{k}1{i:03d}" for i in range(2)]
        rows.append(f"{name} with nothing else")
    terms, found = check_terms(spark, list(enumerate(rows)))
    assert terms >= {n.lower() for n in names}
    planted = [r for r in found if any(n in r.text for n in names)]
    caught = [any(s.kind == 4 for s in r.spans) for r in planted]
    assert sum(caught) >= 0.9 * len(planted)
    clean = [r for r in found if r.text in PLAIN]
    assert sum(not r.spans for r in clean) >= 0.99 * len(clean)


def test_documents_have_disclosing_terms(spark, folder):
    rows = [(r.doc_id, r.text) for r in table(spark, folder.replace("0.001", "0.01"), "documents").collect()]
    check_terms(spark, rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, k1 string, spans int")
    assert privacy.find(none).count() == 0


@pytest.mark.parametrize("column", ["spans", "flags", "entity", "k1"])
def test_clashing_names(spark, column):
    frame = spark.createDataFrame([(1, "a@b.cd", "x")], f"doc_id long, text string, {column} string")
    assert len(privacy.find(frame).first().spans) == 1
