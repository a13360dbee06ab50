import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.llm import mixing
from lakewright.llm.queries import op9
from lakewright.sources.tables import table

KNOWN = "n_tokens long, posterior array<double>"


def brute(n, p, goal, rounds=20000):
    """Rates by plain projected gradient steps from 1."""
    r = np.ones(len(n))
    a = n[:, None] * p / n.sum()
    metric = np.linalg.inv(p.T @ a + 1e-6 * np.trace(p.T @ a) * np.eye(p.shape[1]))
    for _ in range(rounds):
        miss = r @ a - goal
        if np.abs(miss).max() < 1e-9:
            break
        r = np.maximum(r - p @ (metric @ miss), 0)
    return r


@pytest.mark.parametrize("targets", [{"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 0.9, "b": 0.1, "c": 0.0001}])
def test_rates_reach_targets(spark, targets):
    rng = np.random.default_rng(5)
    n = rng.integers(1, 500, 400)
    p = rng.dirichlet([0.3, 0.2, 0.1], 400)
    known = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], KNOWN)
    mixture = mixing.fit_rates(known, targets)
    rates = np.array([r[0] for r in known.select(mixing.rate(mixture.steps)).collect()])
    goal = np.array(list(targets.values())) / sum(targets.values())
    assert (rates >= 0).all()
    best = brute(n.astype(float), p, goal)
    got, wanted = (x @ (n[:, None] * p) / n.sum() for x in (rates, best))
    assert np.abs(got - goal).max() <= np.abs(wanted - goal).max() + 1e-3
    assert np.allclose(mixture.totals, got * n.sum())


def test_documents(spark, folder):
    folder = folder.replace("0.001", "0.01")
    rows = op9(spark, folder).toPandas()
    docs = table(spark, folder, "documents")
    assert len(rows) == docs.count()
    parts = rows[["p_good", "p_junk", "p_toxic"]].to_numpy()
    assert np.allclose(parts.sum(axis=1), 1)
    tokens = (rows.n_tokens * rows.rate).to_numpy() @ parts
    assert np.allclose(tokens / tokens.sum(), list(mixing.TARGETS.values()), atol=0.001)
    labels = table(spark, folder, "labels").toPandas().merge(rows, on="doc_id")
    assert (labels[(labels.quality == 1) & (labels.toxic == 0)].p_good > 0.5).mean() > 0.95


def test_mix_repeats_by_rate(spark, folder):
    folder = folder.replace("0.001", "0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rates = {r.doc_id: r.rate for r in mixing.document_rates(docs, labels).collect()}
    mixed = mixing.mix(docs.withColumn("rate", F.lit("x")), labels, whole=None)
    assert mixed.columns == [*docs.columns, "rate"]
    counts = {r[0]: r[1] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(counts.get(i, 0) in (int(r), int(r) + 1) for i, r in rates.items())
    assert sum(counts.values()) == pytest.approx(sum(rates.values()), rel=0.05)
    whole = {r[0] for r in mixing.mix(docs, labels).select("doc_id").distinct().collect()}
    good = {i for i, r in rates.items() if r >= 1}
    assert len(good - whole) <= 0.01 * len(good)


def test_hard_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (None, "some words"), (4, "w " * 60000), (5, "b c"), (5, "b c")], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = mixing.document_rates(docs, labels).collect()
    assert len(got) == 6
    assert all(r.rate == 1 for r in got if r.n_tokens == 0)
    assert mixing.document_rates(docs.limit(0), labels).count() == 0
    assert mixing.mix(docs.limit(0), labels.limit(0)).count() == 0
    assert len(mixing.document_rates(docs, labels.limit(0)).collect()) == 6
