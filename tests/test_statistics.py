"""Histograms, pooling, routing, recommendation and training logs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.operators import histograms as H
from lakewright.operators import pooling as E
from lakewright.operators import recommend as R
from lakewright.operators import training_logs as L
from lakewright.operators.routing import Router, score_every, score_routed, score_soft


def test_equal_height_ranges_with_hot_value(spark):
    rng = random.Random(2)
    values = [7.0] * 400 + [round(rng.uniform(0, 100), 1) for _ in range(603)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = H.build(H.column_counts(df, ["v"], []), few_values=5).orderBy("lo", "hi", "avg", "height").collect()
    ordered = sorted(values)
    base, extra = divmod(len(ordered), 10)
    at, expected = 0, []
    for b in range(10):
        part = ordered[at:at + base + (b < extra)]
        at += len(part)
        expected.append((part[0], part[-1], sum(part) / len(part), len(part) / len(ordered)))
    assert len(got) == 10
    for r, (lo, hi, mean, height) in zip(got, sorted(expected)):
        assert (r.lo, r.hi) == (lo, hi) and math.isclose(r.avg, mean) and math.isclose(r.height, height)
    assert sum(r.closed for r in got) == 1


TEXT = """Table: region
  Column: r_comment
    a, b and more: 20.00%: avg = a, height = 0.2000
    plain: 40.00%: avg = p, height = 0.8000

  Column: c_acctbal
    [-999.99, 99.84): avg = -449.9, height = 0.4000
    [99.84, 1201.49]: avg = 651.6, height = 0.6000
  Column: c_nationkey
    5: 4.03%: avg = 5: 4.03%, height = 0.0403
"""


def test_histogram_text(spark):
    rows = H.parse_text(spark.createDataFrame([("t", TEXT)], "file_name string, text string")).collect()
    got = {(r.column, r.value, r.lo, r.hi, r.height) for r in rows}
    assert got == {
        ("r_comment", "a, b and more", None, None, 0.2), ("r_comment", "plain", None, None, 0.8),
        ("c_acctbal", None, -999.99, 99.84, 0.4), ("c_acctbal", None, 99.84, 1201.49, 0.6), ("c_nationkey", "5", None, None, 0.0403),
    }


@pytest.mark.parametrize(
    "op, literal, compat, expected",
    [
        ("<", "500", False, 0.4), ("<", "500", True, 0.0), ("<", "-1000", True, 1.0), (">", "-2000", False, 1.0),
        (">", "-2000", True, 0.0), (">", "5000", True, 1.0), ("=", "99.84", False, 1.0), ("=", "500", False, 0.6),
    ],
)
def test_range_direction(spark, op, literal, compat, expected):
    hist = H.parse_text(spark.createDataFrame([("t", TEXT)], "file_name string, text string"))
    nested = H.nest(hist).where("column = 'c_acctbal'")
    got = nested.select(H.selectivity(F.col("buckets"), F.lit(op), F.array(F.lit(literal)), compat).alias("s")).first().s
    assert math.isclose(got, expected)


def test_estimates(spark):
    hist = H.nest(H.parse_text(spark.createDataFrame([("t", TEXT)], "file_name string, text string")))
    rows = spark.createDataFrame([("c", 1000), ("r", 5)], "prefix string, n_rows long")
    preds = [
        (1, "c_nationkey", "IN", ["5", "6"], False), (2, "c_nationkey", "=", ["5"], True), (3, "r_comment", "LIKE", ["%a%"], False),
        (4, "c_acctbal", "=", ["o_x#3"], False), (5, "c_other", "=", ["1"], False), (6, "r_comment", "=", ["plain"], False),
    ]
    df = spark.createDataFrame(preds, "id int, column string, op string, values array<string>, negated boolean")
    got = {r.id: round(r.estimated, 4) for r in H.estimate(df, hist, rows).collect()}
    assert got == {1: 40.3, 2: 959.7, 3: 0.5, 4: 1000.0, 5: 0.0, 6: 4.0}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    data = [(i % 3, rng.normal(size=4).tolist()) for i in range(40)] + [(9, [1.0, 2.0, 3.0, 4.0])]
    return data, spark.createDataFrame(data, "workload_id int, embedding array<double>")


def test_attention_pool(vectors):
    data, df = vectors
    heads = np.random.default_rng(6).normal(size=(2, 4)) * 30
    got = {r.workload_id: r.pooled for r in E.attention_pool(df, heads.tolist(), [0.1, -0.2]).collect()}
    for w in (0, 1, 2, 9):
        x = np.array([v for k, v in data if k == w])
        parts = []
        for h, b in zip(heads, (0.1, -0.2)):
            s = x @ h + b
            a = np.exp(s - s.max())
            parts.append((a / a.sum()) @ x)
        assert np.allclose(got[w], np.concatenate([*parts, x.mean(0), x.max(0)]))


def test_plain_pool_and_spread(vectors):
    data, df = vectors
    got = {r.workload_id: r.pooled for r in E.mean_max_std(df).collect()}
    assert got[9] == [1.0, 2.0, 3.0, 4.0] * 2 + [0.0] * 4
    x = np.array([v for k, v in data if k == 0])
    assert np.allclose(got[0], np.concatenate([x.mean(0), x.max(0), x.std(0)]))
    spread = {r.batch_id: r for r in E.spread(df.withColumnRenamed("workload_id", "batch_id")).collect()}
    assert 9 not in spread
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    off = cos[~np.eye(len(x), dtype=bool)].mean()
    assert math.isclose(spread[0].cosine, off, abs_tol=1e-9) and math.isclose(spread[0].variance, x.var(0).mean())


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(8)
    rows = [(rng.normal(size=6).tolist(), rng.normal(size=3).tolist(), i % 3, (i // 3) % 3) for i in range(60)]
    return rows, spark.createDataFrame(rows, "e array<double>, c array<double>, engine_id int, lake_id int"), Router.seeded(6, 3)


def test_record_routing_equals_fixed_routing(scored):
    _, df, router = scored
    own = score_routed(df, router, "e", "c", F.col("engine_id"), F.col("lake_id")).collect()
    for engine in range(3):
        for lake in range(3):
            fixed = score_routed(df, router, "e", "c", F.lit(engine), F.lit(lake)).collect()
            pairs = [(a.pred, b.pred) for a, b in zip(own, fixed) if (a.engine_id, a.lake_id) == (engine, lake)]
            assert pairs and all(math.isclose(a, b, rel_tol=1e-9) for a, b in pairs)


def test_every_pair_in_one_pass(scored):
    """All nine predictions of a record come from one function over each batch, those of the pair routed alone."""
    rows, df, router = scored
    every = score_every(df, router, "e", "c")
    got = np.array([r.preds for r in every.collect()])
    e, c = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for pair in range(9):
        assert np.allclose(got[:, pair], router.hard(e, c, *divmod(pair, 3)), rtol=1e-12)
    big = np.tile(e, (50, 1)), np.tile(c, (50, 1))
    assert np.allclose(router.every(*big), np.tile(got, (50, 1)), rtol=1e-12)
    assert every._jdf.queryExecution().executedPlan().toString().count("predict(") > 0
    assert score_every(df.limit(0), router, "e", "c").collect() == []


def test_ragged_vectors_are_refused(spark):
    df = spark.createDataFrame([([1.0] * 6, [1.0] * 2, 0, 0), ([1.0] * 6, [1.0] * 4, 0, 0)], "e array<double>, c array<double>, engine_id int, lake_id int")
    with pytest.raises(Exception, match="lengths"):
        score_routed(df.coalesce(1), Router.seeded(6, 3), "e", "c", F.col("engine_id"), F.col("lake_id")).collect()


def test_soft_routing(scored):
    rows, df, router = scored
    got = score_soft(df, router, "e", "c").collect()
    e, c = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    pred, engine, _ = router.soft(e, c)
    assert np.allclose([r.scored.pred for r in got], pred) and np.allclose([r.scored.engine_logits for r in got], engine)
    # A certain gate leaves one expert pair.
    one = np.tile(np.eye(3)[1], (len(rows), 1))
    assert np.allclose(router._mixed(e, c, one, one), router.hard(e, c, 1, 1))


def test_pick_and_fallback(spark):
    schema = "benchmark string, query_id string, engine_id int, lake_id int, conf string, latency double, pred double"
    rows = [
        ("b", "q1", 0, 0, "a", 10.0, 0.5), ("b", "q1", 0, 0, "b", 30.0, 0.1), ("b", "q1", 1, 1, "c", 5.0, 0.0),
        ("b", "q2", 1, 1, "d", 8.0, 0.9), ("b", "q2", 2, 2, "e", 4.0, 0.9),
    ]
    chosen = spark.createDataFrame([("b", "q1", 0, 0), ("b", "q2", 0, 0)], "benchmark string, query_id string, engine_star int, lake_star int")
    got = {r.query_id: r for r in R.pick_per_query(spark.createDataFrame(rows, schema), chosen).collect()}
    assert got["q1"].pick_conf == "b" and got["q1"].ratio == 6.0 and not got["q1"].fallback
    assert got["q2"].pick_conf == "d" and got["q2"].ratio == 2.0 and got["q2"].fallback
    metrics = R.query_metrics(R.pick_per_query(spark.createDataFrame(rows, schema), chosen)).first()
    assert metrics.mean_ratio == 4.0 and metrics.combo_acc == 0.0 and metrics.n_fallback == 1


def test_training_log_forms(spark):
    lines = [
        ("train_a_sf1.log", 1, "  Epoch   1: s1=1.5 (mse=0.1 ce=1.4 div=0.0) s2=0.2 s3=0.3 valid_ratio=1.9000  best_valid=1.9000@ep1"),
        ("train_a_sf1.log", 2, "Training complete. Best valid ratio: 1.9000 at epoch 1"),
        ("train_a_sf1.log", 3, "Final test ratio (best-valid snapshot, ep1): 2.0000"),
        ("train_b.log", 1, "Epoch 3: expert=0.5 test_ratio=1.2 best=1.1@ep2 (target=1.05)"),
        ("train_b.log", 2, "Training complete. Best valid ratio: 1.1 at epoch 2"),
        ("train_c.log", 1, "nothing"),
        ("other.log", 1, "Training complete. Best valid ratio: 9 at epoch 2"),
    ]
    runs = L.run_logs(spark.createDataFrame(lines, "file_name string, line_no int, line string"))
    emitted = L.emitted_epochs(runs).first()
    assert (emitted.run, emitted.epoch, emitted.ce, emitted.best_epoch) == ("a_sf1", 1, 1.4, 1)
    chart = L.chart_epochs(runs).first()
    assert (chart.run, chart.loss, chart.target) == ("b", 0.5, 1.05)
    assert sorted(map(tuple, L.summary(runs).collect())) == [("a_sf1", "1.9000", "2.0000"), ("b", "1.1", "N/A")]


def test_best_so_far_ties(spark):
    ratios = [3.0, 2.0, 2.0, 5.0, 1.0]
    df = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(ratios)], "run string, epoch int, ratio double")
    got = [(r.best_ratio, r.best_epoch) for r in L.best_so_far(df, ["run"], ["epoch"], "ratio").orderBy("epoch").collect()]
    assert got == [(3.0, 1), (2.0, 2), (2.0, 2), (2.0, 2), (1.0, 5)]
    assert L.select_model(df, ["run"], ["epoch"], "ratio").first().best_epoch == 5


def test_out_of_range_dates_give_no_rows(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    assert orders.where("o_orderdate >= '2023-01-01' AND o_orderdate <= '2023-12-31'").count() == 0


def test_text_columns_with_many_values_have_ranges(spark):
    names = [f"name, {i:03d}" for i in range(100)]
    df = spark.createDataFrame([(n, float(i % 7)) for i, n in enumerate(names) for _ in range(1 + i % 3)], "t string, x double")
    hist = H.build(H.column_counts(df, ["x"], ["t"]), buckets=5)
    ranges = hist.where("column = 't'").orderBy("lo_text").collect()
    assert len(ranges) == 5 and sum(r.height for r in ranges) == pytest.approx(1)
    assert (ranges[0].lo_text, ranges[-1].hi_text) == (names[0], names[-1])
    parsed = H.parse_text(H.to_text(hist))
    again = sorted((r.lo_text, r.hi_text) for r in parsed.where("column = 't'").collect())
    assert again == [(r.lo_text, r.hi_text) for r in ranges]
    predicates = spark.createDataFrame(
        [("t", "<", [names[50]], False), ("t", ">=", [names[0]], False), ("t", "=", [names[10]], False)],
        '"column" string, op string, "values" array<string>, negated boolean'.replace('"', "`"),
    )
    rows = spark.createDataFrame([("t", 1000)], "prefix string, n_rows long")
    got = {r.op: r.estimated for r in H.estimate(predicates, H.nest(parsed), rows).collect()}
    assert got[">="] == pytest.approx(1000, abs=1) and got["="] == pytest.approx(200, abs=20)
    assert 350 <= got["<"] <= 500


@pytest.mark.parametrize("n", [10, 100_000])
def test_bucket_hits_in_order_equal_broadcast(spark, n):
    """The same hits with few and with many buckets, on shared edges, buckets of one value, hot and missing values."""
    hist = spark.range(n).select(
        F.lit("p").alias("column"), (F.col("id") * 2.0).alias("lo"),
        F.when(F.col("id") % 5 == 3, F.col("id") * 2.0).otherwise(F.col("id") * 2.0 + 2.0).alias("hi"), F.lit(1.0 / n).alias("height"),
    )
    hist = hist.union(spark.createDataFrame([("p", 4.0, 4.0, 0.5), ("p", 4.0, 4.0, 0.25), ("q", 0.0, 1.0, 1.0), ("p", None, None, 1.0)], "column string, lo double, hi double, height double"))
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 4.0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 97 * 0.5 - 1).alias("v"),
        F.when(F.col("id") % 10 < 8, "p").otherwise("r").alias("column"), F.lit("x").alias("n_buckets"),
    )
    small, large = (
        {r.id: (r.n_buckets, round(r.height, 9)) for r in H.bucket_hits(rows, hist.where("lo IS NULL OR lo < 120"), "v", limit).collect()}
        for limit in (1 << 40, 0)
    )
    assert small == large and len(small) == 2400
    whole = {r.id: (r.n_buckets, round(r.height, 9)) for r in H.bucket_hits(rows, hist, "v", 0).collect()}
    assert whole == large
    assert large[0][0] == 4 if n == 10 else True
