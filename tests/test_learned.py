import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakewright.operators import recommend as R
from lakewright.operators import trials as T
from lakewright.operators import workloads as W
from lakewright.operators.losses import LAMBDA_DIV, LAMBDA_DIVERSITY
from lakewright.operators.mapping import fallback_vectors, latency_profiles, with_fallback
from lakewright.operators.mixture import Gradient, from_vector, gradient_sums, to_vector, train
from lakewright.operators.regression import dot, fit_ridge, sketch
from lakewright.operators.routing import Router
from lakewright.plans import learned as P
from lakewright.session import materialize
from lakewright.sources.derived import query_plan_files

ROWS = "emb array<double>, conf array<double>, engine_id int, lake_id int, target double, weight double, kind int"


def mixture_batch(n, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "emb": list(rng.normal(size=(n, 5))), "conf": list(rng.normal(size=(n, 3))),
            "engine_id": rng.integers(0, 3, n), "lake_id": rng.integers(0, 3, n), "target": rng.normal(size=n),
            "weight": rng.uniform(0.5, 2, n), "kind": [1, 3] * (n // 2),
        }
    )


def test_gradient_is_the_slope_of_the_loss():
    start, rng = Router.seeded(5, 3, width=4), np.random.default_rng(1)
    vector = to_vector(start) + rng.normal(0, 0.1, to_vector(start).size)
    batch, means = mixture_batch(12), np.array([0.2, 0.5, 0.3, 0.6, 0.3, 0.1])
    n1, n3 = (batch[batch.kind == k].weight.sum() for k in (1, 3))

    def loss(v):
        g = Gradient(from_vector(v, start), means, n1, n3)
        g.add(batch)
        slope = 2 * LAMBDA_DIV * (means - 1 / 3) + LAMBDA_DIVERSITY * (np.log(means + 1e-12) + 1)
        return (g.sums[0] + g.sums[1] + (slope * g.sums[3:]).sum()) / n1 + g.sums[2] / n3

    g = Gradient(from_vector(vector, start), means, n1, n3)
    g.add(batch)
    exact = g.vector()[9:]
    for i in rng.choice(vector.size, 80, replace=False):
        step = np.zeros_like(vector)
        step[i] = 1e-6
        assert (loss(vector + step) - loss(vector - step)) / 2e-6 == pytest.approx(exact[i], abs=1e-6, rel=1e-4)


def test_gradient_does_not_depend_on_the_tasks(spark):
    batch, start = mixture_batch(40), Router.seeded(5, 3, width=4)
    plain = Gradient(start, np.full(6, 1 / 3), 20.0, 20.0)
    plain.add(batch)
    for parts in (1, 7, 40):
        rows = spark.createDataFrame([tuple(x.tolist() if hasattr(x, "tolist") else x for x in r) for r in batch.itertuples(index=False)], ROWS)
        assert np.allclose(gradient_sums(rows.repartition(parts), start, np.full(6, 1 / 3), 20.0, 20.0), plain.vector())


def test_training_lowers_the_losses_and_keeps_the_best_epoch(spark):
    rng = random.Random(2)
    rows = []
    for q in range(60):
        emb = [float(q % 3 == i) for i in range(3)]
        rows.append((emb, [1.0], q % 3, (q + 1) % 3, 0.0, 1.0, 1))
        for _ in range(12):
            e, k, x = rng.randrange(3), rng.randrange(3), rng.random() * 4
            rows.append((emb, [x], e, k, abs(x - 1) + (e != q % 3) + (k != (q + 1) % 3), 1.0, 3))
    ratios = iter([3.0, 1.5, 2.0, 1.5])
    kept = []
    router, epochs = train(spark.createDataFrame(rows, ROWS), Router.seeded(3, 1, width=8), lambda r: kept.append(r) or next(ratios), 4, 8)
    assert epochs[-1].s1 < 0.7 * epochs[0].s1 and epochs[-1].s3 < epochs[0].s3
    assert router is kept[1]
    engine, lake = kept[-1].gates(np.eye(3))
    assert engine.argmax(1).tolist() == [0, 1, 2] and lake.argmax(1).tolist() == [1, 2, 0]


def test_no_rows_no_step(spark):
    start = Router.seeded(3, 1, width=4)
    router, epochs = train(spark.createDataFrame([], ROWS), start, lambda r: 1.0, 1, 1)
    assert np.allclose(to_vector(router), to_vector(start)) and epochs[0].s3 == 0.0


def test_ridge_of_many_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(["hot", "b", None][min(i % 7, 2) if i % 7 else 0], [1.0, *rng.normal(size=3).tolist()], rng.normal(size=2).tolist(), float(1 + i % 3)) for i in range(300)]
    rows.append(("b", None, [0.0, 0.0], 1.0))
    df = spark.createDataFrame(rows, "g string, x array<double>, y array<double>, w double").repartition(9)
    got = {r.g: r for r in fit_ridge(df, ["g"], F.col("x"), F.col("y"), F.col("w"), 2.0).collect()}
    assert set(got) == {"hot", "b", None}
    for g, model in got.items():
        x, y, w = (np.array([r[i] for r in rows if r[0] == g and r[1] is not None]) for i in (1, 2, 3))
        a = (x * w[:, None]).T @ x + np.diag([0.0, 2.0, 2.0, 2.0])
        beta = np.linalg.solve(a, (x * w[:, None]).T @ y).T
        assert np.allclose(model.coefficients, beta) and model.n == pytest.approx(w.sum())
        assert np.allclose(model.mse, (w[:, None] * (y - x @ beta.T) ** 2).sum(0) / w.sum())
    assert fit_ridge(df.limit(0), ["g"], F.col("x"), F.col("y")).count() == 0


def test_fallback_rows_are_estimated_from_trials(spark):
    """Queries with a plan teach how latencies go with vectors; the others get a row from their own latencies."""
    rng = np.random.default_rng(5)
    rows, known, true = [], [], {}
    for q in range(40):
        level, tilt = rng.normal(size=2).tolist()
        for e in range(3):
            for k in range(3):
                if (q, e, k) != (3, 1, 1):  # a combo the query was never run on
                    rows.append(("b", f"q{q}", e, k, float(np.exp(5 + level + tilt * (e - 1)))))
        true[f"q{q}"] = [level, tilt, level - tilt, 1.0]
        if q >= 10:
            known.append(("b", f"q{q}", true[f"q{q}"]))
    stats = spark.createDataFrame(rows, "benchmark string, query_id string, engine_id int, lake_id int, best_lat double")
    known = spark.createDataFrame(known, "benchmark string, query_id string, embedding array<double>")
    got = {r.query_id: r.own_embedding for r in fallback_vectors(latency_profiles(stats), known, penalty=1e-3).collect()}
    assert set(got) == {f"q{q}" for q in range(10)}
    assert all(np.allclose(got[q], true[q], atol=0.05) for q in got if q != "q3")
    queries = spark.createDataFrame([("b", "q1", None), ("b", "q2", None), ("b", "q20", "p")], "benchmark string, query_id string, plan_key string")
    plans = spark.createDataFrame([("p", [1.0, 2.0, 3.0, 4.0])], "plan_key string, embedding array<double>")
    own = spark.createDataFrame([("b", q, v) for q, v in got.items()], "benchmark string, query_id string, own_embedding array<double>")
    merged = {r.query_id: r for r in with_fallback(queries, plans, own).collect()}
    assert [merged[q].is_fallback for q in ("q1", "q2", "q20")] == [True, True, False]
    assert all(abs(sum(r.embedding)) < 1e-9 for r in merged.values())


@pytest.fixture(scope="module")
def structured(spark):
    """A log in which vector, combo and configuration decide the latency."""
    rng = random.Random(7)
    rows = []
    for q in range(60):
        for _ in range(60):
            e, k, x = rng.randrange(3), rng.randrange(3), rng.randrange(1, 9)
            base = 2000.0 * (1 + (e != q % 3)) * (1 + (k != q % 2)) * (1 + abs(x - 2 - q % 3))
            rows.append(("b", f"sf1_q{q}", e, k, str(x), [float(x), float(e), float(k)], base * rng.uniform(0.95, 1.05)))
    names = "benchmark string, query_id string, engine_id int, lake_id int, conf string, config array<double>, latency double"
    log = materialize(spark.createDataFrame(rows, names))
    vectors = spark.createDataFrame(
        [("b", f"sf1_q{q}", q % 5 == 0, [float(q % 3 == i) for i in range(3)] + [float(q % 2), 0.0] * 2) for q in range(60)],
        "benchmark string, query_id string, is_fallback boolean, embedding array<double>",
    )
    stats, splits = materialize(W.combo_stats(log)), materialize(T.split_queries(T.query_ids(log)))
    return P.Setup(log, log, stats, materialize(sketch(vectors, "embedding", P.SKETCH, "sketch")), splits, 3)


def test_learned_picks_beat_random_and_formula(structured):
    s = structured
    picks = P.learned_picks(s)
    rows = picks.join(P.random_ratio(s), T.QUERY).collect()
    assert {r.query_id for r in rows} == {r.query_id for r in s.of("test").collect()}
    learned, chance = (float(np.mean([r[c] for r in rows])) for c in ("ratio", "random_ratio"))
    formula = s.trials.withColumn("pred", R.linear_score(F.col("config"), [3.0, -5.0, 7.0]))
    anywhere = s.of("test").withColumns({"engine_star": F.lit(9), "lake_star": F.lit(9)})
    fixed = R.pick_per_query(formula, anywhere).agg(F.avg("ratio")).first()[0]
    assert learned < 0.5 * chance and learned < fixed


def test_experts_are_one_model_per_combo(structured):
    s = structured
    experts = P.train_experts(P.expert_records(s, s.of("train"), True), T.COMBO, 1.0)
    assert sorted((r.engine_id, r.lake_id) for r in experts.collect()) == [(e, k) for e in range(3) for k in range(3)]
    without = experts.where("engine_id <> 2")
    scored = P.expert_scores(P.expert_records(s, s.of("test"), False), without, T.COMBO)
    assert scored.where("engine_id = 2 AND pred < 1e9 OR engine_id <> 2 AND pred > 1e9").count() == 0
    assert dot(F.array(F.lit(2.0)), F.array(F.lit(3.0))) is not None


def test_plan_texts_decide_the_picks(spark, folder):
    """The same log with the texts of the plans exchanged gives other vectors and other picks."""
    files = query_plan_files(spark, folder)
    swapped = files.withColumn("place", F.row_number().over(P.Window.orderBy("file_name")))
    n = swapped.count()
    moved = swapped.select(F.pmod(F.col("place") + 3, F.lit(n)).alias("place"), "text")
    swapped = swapped.withColumn("place", F.pmod("place", F.lit(n))).select("file_name", "place").join(moved, "place").select("file_name", "text")
    picks = []
    for texts in (files, swapped):
        s = P.setup(spark, folder, texts)
        assert s.vectors.where("embedding IS NULL OR sketch IS NULL").count() == 0
        assert s.vectors.where("is_fallback").count() > 0 and s.vectors.where("NOT is_fallback").count() > 0
        rows = P.learned_picks(s, penalties=(1.0,)).collect()
        assert {r.query_id for r in rows} <= {r.query_id for r in s.of("test").collect()} and all(r.ratio >= 1 for r in rows)
        picks.append({(r.benchmark, r.query_id): (r.pick_engine_id, r.pick_lake_id, r.pick_conf) for r in rows})
    assert picks[0] != picks[1]


def test_ridge_reads_its_rows_only_when_asked(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Rows

    data = [("a", float(i), 2.0 * i + 1, -float(i)) for i in range(8)] + [(None, 1.0, 5.0, 6.0)]
    rows = spark.createDataFrame(data, "k string, x double, y double, z double")
    with monkeypatch.context() as patched:
        patched.setattr(Rows, "collect", lambda self: pytest.fail("the rows were read while the job was planned"))
        models = fit_ridge(rows, ["k"], F.array(F.lit(1.0), "x"), F.array("y", "z"), penalty=0.0)
    got = {r.k: (r.n, r.coefficients) for r in models.collect()}
    assert got["a"][0] == 8 and got[None][0] == 1
    assert [[round(v, 6) for v in beta] for beta in got["a"][1]] == [[1.0, 2.0], [0.0, -1.0]]
