import random

from pyspark.sql import functions as F

from lakewright.operators import learning as M
from lakewright.operators import recommend as R
from lakewright.operators import trials as T
from lakewright.operators import workloads as W


def test_trained_expert_beats_a_random_pick(spark):
    rng = random.Random(3)
    rows = []
    for q in range(24):
        for _ in range(40):
            engine, lake, knob = rng.randrange(3), rng.randrange(3), rng.randrange(1, 9)
            latency = 1000.0 * (1 + q % 5) * (1 + abs(knob - 4)) * (1 + 0.3 * engine) * rng.uniform(0.9, 1.1)
            rows.append(("b", f"q{q}", engine, lake, str(knob), [float(knob), float(engine), float(lake)], latency))
    names = "benchmark string, query_id string, engine_id int, lake_id int, conf string, config array<double>, latency double"
    trials = spark.createDataFrame(rows, names)
    best = W.query_best(W.combo_stats(trials))
    is_test = F.substring("query_id", 2, 9).cast("int") >= 16
    features = M.expert_features(F.col("config"), F.col("engine_id"), F.col("lake_id"), 3)
    expert = M.train_expert(W.with_ratio(trials.where(~is_test), best), features, max_iter=10)
    scored = expert.transform(trials.where(is_test).withColumn("features", features)).withColumnRenamed("prediction", "pred")
    anywhere = trials.where(is_test).select(*T.QUERY).distinct().withColumns({"engine_star": F.lit(9), "lake_star": F.lit(9)})
    picks = [r.ratio for r in R.pick_per_query(scored, anywhere).collect()]
    at_random = trials.where(is_test).groupBy(*T.QUERY).agg((F.avg("latency") / F.min("latency")).alias("r"))
    assert len(picks) == 8 and min(picks) >= 1
    assert sum(picks) < 0.6 * sum(r.r for r in at_random.collect())
