import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.llm import langid
from lakewright.llm.langid import LanguageModel
from lakewright.sources.tables import table

SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark, folder):
    return table(spark, folder.replace("0.001", "0.01"), "documents")


@pytest.fixture(scope="module")
def model(docs):
    return langid.train(docs, per_language=60, max_contexts=1024)


def test_held_out_accuracy(docs, model):
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_is_proper(model):
    """In every context the code lengths of the 256 bytes sum to probability one."""
    chance = np.exp2(-model.bits.reshape(len(model.langs), -1, 256) / langid.UNIT)
    assert np.allclose(chance.sum(axis=2), 1, atol=0.01)


def brute_bits(texts, text, order):
    """Code length under method C with exclusion, counts from plain dictionaries."""
    counts = {}
    for t in texts:
        b = b"\0" * order + t.encode()
        for i in range(order, len(b)):
            for o in range(order + 1):
                counts.setdefault(b[i - o : i], {}).setdefault(b[i], 0)
                counts[b[i - o : i]][b[i]] += 1

    def table_of(context):
        base = np.full(256, 1 / 256) if context is None else table_of(context[1:] if context else None)
        seen = counts.get(context, {}) if context is not None else {}
        if not seen:
            return base
        n, d = sum(seen.values()), len(seen)
        out = np.array([seen.get(s, 0) / (n + d) for s in range(256)])
        rest = base * np.array([s not in seen for s in range(256)])
        return out + rest * d / (n + d) / rest.sum()

    b = b"\0" * order + text.encode()
    return sum(-math.log2(table_of(b[i - order : i])[b[i]]) for i in range(order, len(b)))


def test_code_lengths_match_brute_force(spark):
    rows = [(1, "the theme of the thing", "en"), (2, "ähnlich über öl und der", "de"), (4, "a thing or two", "en")]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    assert model.langs == ["de", "en"]
    for text in ("the öl", "zzz", "a", "thing über thing"):
        data = np.frombuffer(text.encode(), np.uint8)
        got = langid.code_lengths(model, data, np.array([0, len(data)]))[0]
        for k, lang in enumerate(model.langs):
            expected = brute_bits([t for _, t, l in rows if l == lang], text, langid.ORDER)
            assert got[k] == pytest.approx(expected, abs=0.01)


def test_hard_rows(spark, model):
    rows = [
        (1, None, "en"), (2, "", None), (3, "12 %%", "fr"), (None, "the of and that", None), (5, "the of and that", "de"),
        (5, "the of and that", "de"), (7, "der die und " * 20000, "en"), (8, "\0é", None),
    ]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")), model).collect()
    by_text = {(r.doc_id, r.held_out): (r.lang_pred, r.score) for r in got}
    assert len(got) == len(rows)
    assert by_text[1, False] == by_text[3, False] == ("und", 0.0)
    assert by_text[None, False][0] == by_text[5, False][0] == "en"
    assert by_text[7, False][0] == "de"
    kept = langid.keep_identified(spark.createDataFrame(rows, SCHEMA).withColumn("lang_pred", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5, 5, 7]  # two stray bytes cost more than eight bits each


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = langid.train(empty)
    assert model == LanguageModel([], model.step, model.bits)
    assert langid.identify(empty, model).count() == 0
    one = spark.createDataFrame([(1, "abc", "en")], SCHEMA)
    assert langid.identify(one, model).first().lang_pred == "und"
