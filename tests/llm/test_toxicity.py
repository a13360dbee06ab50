import numpy as np
from pyspark.sql import functions as F

from lakewright.llm import toxicity
from lakewright.llm.linear import DIM, Ftrl, Weights, margins, rows_of, word_features
from lakewright.llm.textbatch import words_of
from lakewright.sources.tables import table


def words(*texts):
    parts = [t.encode() for t in texts]
    return words_of(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))


def test_held_out_scores(spark, folder):
    folder = folder.replace("0.001", "0.1")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    toxic, clean = scored[scored.toxic == 1], scored[scored.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.75
    assert (clean.predicted == 0).mean() > 0.99
    assert ((scored.score >= 0.5) == (scored.predicted == 1)).all()


def test_held_out_recall_per_language(spark, folder):
    folder = folder.replace("0.001", "0.1")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out AND score IS NOT NULL")
    got = scored.join(labels.where("toxic = 1"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    recall = (got.predicted == 1).groupby(got.lang).mean()
    assert set(recall.index) == {"de", "en", "es", "fr"}
    assert recall.min() > 0.75, recall.to_dict()


def test_rare_words_and_classes_reach_the_sample(spark):
    rows = [(i, f"plain words number {i % 97} with friends", "en", 0) for i in range(3000)]
    rows += [(10000 + i, f"plain words number {i} with palabrota", "es", 1) for i in range(9)]
    rows += [(20000 + i, f"plain words number {i} with badword", "en", 1) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    docs, labels = frame.drop("toxic"), frame.select("doc_id", "toxic")
    sample, shift = toxicity.toxic_first_sample(docs, labels, 400)
    drawn = {(r["lang"], r["label"]): r["count"] for r in sample.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "label").count().collect()}
    assert drawn["es", 1] == docs.where("lang = 'es'").where(~toxicity.held_out(F.col("doc_id"))).count()
    assert drawn["en", 1] > 150 and 130 < drawn["en", 0] < 270 and shift > 1
    model = toxicity.train(docs, labels, rows=400)
    probe = spark.createDataFrame([(1, "plain words number 5 with palabrota"), (2, "plain words number 5 with badword"), (3, "plain words number 5 with friends")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(probe, model).orderBy("doc_id").collect()] == [1, 1, 0]


def test_margins_match_rows():
    batch = words("a b c a b", "", "b", "x y z")
    kinds = word_features(batch)
    dense = np.random.default_rng(0).normal(size=(2, DIM)) * (np.arange(DIM) % [[3], [2]] == 0)
    weights = Weights([(np.flatnonzero(w), w[w != 0]) for w in dense])
    expected = [[w[at] @ x for w in dense] for at, x in rows_of(kinds, batch.first)]
    assert np.allclose(margins(weights, kinds, batch.first), expected, atol=1e-5)
    assert margins(Weights([(np.zeros(0, int), np.zeros(0))]), kinds, batch.first).tolist() == [[0.0]] * 4


def test_pairs_stay_in_their_text():
    kinds = word_features(words("a b", "c"))
    assert [k.tolist() for k in np.sign(kinds + np.array(1))] == [[1, 1, 1], [1, 0, 0], [0, 0, 0]]


def test_ftrl_is_sparse_and_learns():
    model = Ftrl(l1=1.0)
    for _ in range(20):
        model.learn(np.array([1, 5]), np.ones(2), 1)
        model.learn(np.array([2, 5]), np.ones(2), 0)
    at, weight, _ = model.sparse()
    assert set(at) <= {1, 2, 5} and dict(zip(at, weight))[1] > 0 > dict(zip(at, weight))[2]


def test_hard_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "idiot " * 50000), (None, "good words"), (3, "other"), (6, "good words")],
        "doc_id long, text string",
    ).withColumn("predicted", F.lit("x"))
    labels = spark.createDataFrame([(1, None), (3, 1), (3, 0), (6, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 6
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    empty = toxicity.train(docs.limit(0), labels.limit(0))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), empty).count() == 0
