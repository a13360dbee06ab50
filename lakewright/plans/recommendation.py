"""Queries that embed, route, score and evaluate recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.functions.catalog import SWEEP
from lakewright.operators import features as X
from lakewright.operators import learning as M
from lakewright.operators import pooling as E
from lakewright.operators import recommend as R
from lakewright.operators import trees as G
from lakewright.operators import trials as T
from lakewright.operators import workloads as W
from lakewright.operators.routing import Router, encode_config
from lakewright.operators.skew import split_scan
from lakewright.operators.treeconv import KERNELS, plan_embeddings, seeded_layers
from lakewright.plans import sqltext as Q
from lakewright.plans.plan_log import plan_features
from lakewright.plans.registry import query
from lakewright.plans.trial_log import repaired
from lakewright.plans.workload import sampled
from lakewright.session import materialize
from lakewright.sources.tables import table

_BASE = (Q.RAW, Q.ACCEPTED, Q.REPAIRED, Q.STATS, Q.SPLIT)
_TEST = (*_BASE, Q.workloads("test", 50, 8))
WEIGHTS = [3.0, -5.0, 7.0, 2.0, 11.0, -4.0]

_SCORED = f"""dense AS (SELECT benchmark, query_id, row_number() OVER (ORDER BY benchmark, query_id) - 1 AS q_idx FROM ids),
qemb AS (SELECT benchmark, query_id, embedding FROM dense JOIN embeddings ON vec_id = q_idx % (SELECT count(*) FROM embeddings)),
gates AS (SELECT benchmark, query_id, list_position(embedding[1:3], list_max(embedding[1:3])) - 1 AS engine_star,
  list_position(embedding[4:6], list_max(embedding[4:6])) - 1 AS lake_star FROM qemb),
scored AS (SELECT *, list_sum(list_transform(config, lambda x, i: x * list_extract({WEIGHTS}, (i - 1) % {len(WEIGHTS)} + 1))) AS pred FROM repaired),
chosen AS (
  SELECT s.*, engine_star, lake_star, bool_or(engine_id = engine_star AND lake_id = lake_star) OVER (PARTITION BY benchmark, query_id) AS has_match
  FROM scored s JOIN gates USING (benchmark, query_id)),
cands AS (SELECT * FROM chosen WHERE NOT has_match OR (engine_id = engine_star AND lake_id = lake_star)),
picks AS (
  SELECT c.*, latency / query_best AS ratio, best_engine_id, best_lake_id
  FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, query_id ORDER BY pred, engine_id, lake_id, conf, latency) AS rn FROM cands) c
  JOIN qbest USING (benchmark, query_id) WHERE rn = 1)"""


def query_vectors(spark, folder, queries):
    """One vector per query: the base table's vector with the query's dense id, used in turn."""
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("place"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    n = vectors.agg(F.count("*")).scalar()
    placed = T.dense_ids(queries).withColumn("place", F.pmod("q_idx", n))
    return placed.join(vectors, "place").select(*T.QUERY, "embedding")


def chosen_combos(spark, folder, queries):
    e = F.col("embedding")
    return R.choose_combo(query_vectors(spark, folder, queries), F.slice(e, 1, 3), F.slice(e, 4, 3))


def scored_trials(spark, folder, trials=None, stats=None):
    trials = materialize(repaired(spark, folder)) if trials is None else trials
    stats = materialize(W.combo_stats(trials)) if stats is None else stats
    scored = trials.withColumn("pred", R.linear_score(F.col("config"), WEIGHTS))
    return scored, stats, stats.select(*T.QUERY).distinct()


@query(
    "j7_candidate_records",
    Q.with_(*_BASE, _SCORED, select=f"SELECT {Q.REC}, conf, round(latency, 4) AS latency, NOT has_match AS fallback FROM cands"),
)
def _(spark, folder):
    scored, stats, queries = scored_trials(spark, folder)
    rows = R.candidates(scored, stats, chosen_combos(spark, folder, queries))
    return rows.select(*T.RECORD, "conf", F.round("latency", 4).alias("latency"), "fallback")


_PICK = """SELECT benchmark, query_id, engine_id AS pick_engine_id, lake_id AS pick_lake_id, conf AS pick_conf,
  round(latency, 4) AS pick_latency, NOT has_match AS fallback, round(ratio, 4) AS ratio FROM picks"""


def picks(spark, folder, trials=None, stats=None):
    scored, stats, queries = scored_trials(spark, folder, trials, stats)
    return R.pick_per_query(scored, chosen_combos(spark, folder, queries)), stats


@query("w7_lowest_prediction", Q.with_(*_BASE, _SCORED, select=_PICK))
def _(spark, folder):
    rows, _ = picks(spark, folder)
    return rows.select(
        *T.QUERY, "pick_engine_id", "pick_lake_id", "pick_conf", F.round("pick_latency", 4).alias("pick_latency"),
        "fallback", F.round("ratio", 4).alias("ratio"),
    )


_METRICS = """round(avg(ratio), 4) AS mean_ratio, round(avg((engine_id = best_engine_id)::int), 4) AS engine_acc,
  round(avg((lake_id = best_lake_id)::int), 4) AS lake_acc, round(avg((engine_id = best_engine_id AND lake_id = best_lake_id)::int), 4) AS combo_acc,
  count(*) AS n"""


def _rounded(df, *keep):
    names = ["mean_ratio", "engine_acc", "lake_acc", "combo_acc"]
    return df.select(*keep, *[F.round(c, 4).alias(c) for c in names if c in df.columns], "n", *[c for c in ("n_fallback",) if c in df.columns])


@query(
    "m9_recommendation",
    Q.with_(*_TEST, _SCORED, select="SELECT workload_id, " + _PICK[7:] + " JOIN members USING (benchmark, query_id)"),
)
def recommendation(spark, folder):
    """Per test workload and query: chosen engine, lake and configuration, and its regret."""
    trials, stats, members = sampled(spark, folder, "test", 50, 8)
    rows, _ = picks(spark, folder, trials, stats)
    return members.select("workload_id", *T.QUERY).join(rows, T.QUERY).select(
        "workload_id", *T.QUERY, "pick_engine_id", "pick_lake_id", "pick_conf",
        F.round("pick_latency", 4).alias("pick_latency"), "fallback", F.round("ratio", 4).alias("ratio"),
    )


@query(
    "a10_query_metrics",
    Q.with_(*_TEST, _SCORED, select=f"SELECT {_METRICS}, count(*) FILTER (NOT has_match) AS n_fallback FROM picks JOIN members USING (benchmark, query_id)"),
)
def _(spark, folder):
    trials, stats, members = sampled(spark, folder, "test", 50, 8)
    rows, _ = picks(spark, folder, trials, stats)
    return _rounded(R.query_metrics(rows, members))


_POOLED = """pool AS (SELECT m.workload_id, s.* FROM scored s JOIN members m USING (benchmark, query_id)),
wpicks AS (
  SELECT *, latency / min(latency) OVER (PARTITION BY workload_id) AS ratio,
    row_number() OVER (PARTITION BY workload_id ORDER BY pred, engine_id, lake_id, benchmark, query_id, conf, latency) AS rn FROM pool),
wbest AS (SELECT workload_id, arg_min(engine_id, (total_lat, engine_id, lake_id)) AS best_engine_id, arg_min(lake_id, (total_lat, engine_id, lake_id)) AS best_lake_id
  FROM totals GROUP BY 1)"""


def workload_picks(spark, folder):
    trials, stats, members = sampled(spark, folder, "test", 50, 8)
    scored = trials.withColumn("pred", R.linear_score(F.col("config"), WEIGHTS))
    return R.pick_per_workload(members, scored), W.workload_best(W.covered_combos(members, stats)), members


@query(
    "m10_pooled_recommendation",
    Q.with_(*_TEST, _SCORED, _POOLED, select="""SELECT workload_id, benchmark AS pick_benchmark, query_id AS pick_query_id, engine_id AS pick_engine_id,
      lake_id AS pick_lake_id, conf AS pick_conf, round(ratio, 4) AS ratio FROM wpicks WHERE rn = 1"""),
)
def _(spark, folder):
    rows, _, _ = workload_picks(spark, folder)
    return rows.drop("pick_latency").withColumn("ratio", F.round("ratio", 4))


@query(
    "a11_pooled_metrics",
    Q.with_(*_TEST, _SCORED, _POOLED, select=f"SELECT {_METRICS} FROM wpicks JOIN wbest USING (workload_id) WHERE rn = 1"),
)
def _(spark, folder):
    rows, best, _ = workload_picks(spark, folder)
    return _rounded(R.workload_metrics(rows, best))


_WGATE = """wdims AS (SELECT workload_id, d, avg(x) AS m FROM (
    SELECT workload_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS d FROM members JOIN qemb USING (benchmark, query_id)) WHERE d <= 6 GROUP BY 1, 2),
wgate AS (SELECT workload_id, arg_max(d, (m, -d)) FILTER (d <= 3) - 1 AS engine_id, arg_max(d, (m, -d)) FILTER (d > 3) - 4 AS lake_id FROM wdims GROUP BY 1)"""


def workload_choices(spark, folder):
    _, stats, members = sampled(spark, folder, "test", 50, 8)
    vectors = query_vectors(spark, folder, stats.select(*T.QUERY).distinct())
    pooled = E.mean_max_std(members.join(vectors, T.QUERY))
    p = F.col("pooled")
    choices = pooled.select(
        "workload_id", S.argmax(F.slice(p, 1, 3)).alias("engine_star"), S.argmax(F.slice(p, 4, 3)).alias("lake_star")
    )
    return choices, W.workload_best(W.covered_combos(members, stats))


@query(
    "a12_gate_accuracy",
    Q.with_(*_TEST, _SCORED, _POOLED, _WGATE, select="SELECT " + _METRICS.replace("round(avg(ratio), 4) AS mean_ratio, ", "") + " FROM wgate JOIN wbest USING (workload_id)"),
)
def _(spark, folder):
    return _rounded(R.gate_accuracy(*workload_choices(spark, folder)))


@query(
    "a12_gate_histogram",
    Q.with_(*_TEST, _SCORED, _WGATE, select="""SELECT 'engine' AS gate, engine_id AS id, count(*) AS n FROM wgate GROUP BY 2
      UNION ALL SELECT 'lake', lake_id, count(*) FROM wgate GROUP BY 2"""),
)
def _(spark, folder):
    return R.gate_histogram(workload_choices(spark, folder)[0])


_PAIRS = ", ".join(f"('{b}', '{s}')" for b, s in SWEEP)


@query(
    "m12_benchmark_scale_sweep",
    Q.with_(
        Q.RAW, Q.ACCEPTED, Q.REPAIRED, Q.STATS, Q.SPLIT, _SCORED,
        f"""pairs AS (SELECT * FROM (VALUES {_PAIRS}) v(benchmark, sf)),
        grouped AS (SELECT benchmark, split_part(substr(query_id, 3), '_', 1) AS sf, query_id FROM ids),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY benchmark, sf ORDER BY md5('42:' || benchmark || ':' || query_id)) - 1 AS rk,
          count(*) OVER (PARTITION BY benchmark, sf) AS n FROM grouped JOIN pairs USING (benchmark, sf)),
        tests AS (SELECT benchmark, sf, query_id FROM ranked WHERE rk >= floor(n * 0.7::double) + floor(n * 0.15::double))""",
        select=f"SELECT tests.benchmark, tests.sf, {_METRICS}, count(*) FILTER (NOT has_match) AS n_fallback FROM picks JOIN tests ON picks.benchmark = tests.benchmark AND picks.query_id = tests.query_id GROUP BY 1, 2",
    ),
)
def _(spark, folder):
    rows, stats = picks(spark, folder)
    scale = F.substring_index(F.expr("substring(query_id, 3)"), "_", 1)
    pair = F.array(*[F.lit(f"{b}|{s}") for b, s in SWEEP])
    queries = stats.select(*T.QUERY, scale.alias("sf")).distinct()
    queries = queries.where(F.array_contains(pair, F.concat("benchmark", F.lit("|"), "sf")))
    keyed = queries.withColumn("_h", F.md5(F.concat_ws(":", F.lit("42"), *T.QUERY)))
    ranked = split_scan(keyed, ["benchmark", "sf"], ["_h", "query_id"], out="rank", total="n")
    cut = F.floor(F.col("n") * F.lit(0.70)) + F.floor(F.col("n") * F.lit(0.15))
    tests = ranked.where(F.col("rank") >= cut).select(*T.QUERY, "sf")
    return _rounded(R.query_metrics(rows.join(tests, T.QUERY), by=["benchmark", "sf"]), "benchmark", "sf")


def _tree_embeddings(spark, folder):
    trees = materialize(X.common_width(materialize(plan_features(spark, folder))))
    width = trees.agg(F.max(F.size(F.get("features", F.lit(0))))).first()[0] or 0
    layers = seeded_layers([3 * width, 256, 128, KERNELS * width])
    return trees, layers


@query("m1_tree_convolution")
def _(spark, folder):
    trees, layers = _tree_embeddings(spark, folder)
    augmented = G.augment(trees.withColumn("parents", G.parents_of("children")), copies=1)
    named = augmented.select(F.col("tree_key").alias("plan_key"), "features", "children")
    embedded = plan_embeddings(named, layers)
    return embedded.select("plan_key", F.get(X.fixed_points(F.array("embedding")), F.lit(0)).alias("embedding"))


def config_width(trials):
    """The widest configuration of the log."""
    return T.max_width(trials).first()[0] or 0


def _router(width):
    return Router.seeded(emb_dim=64, conf_dim=width)


@query("m3_config_encoding")
def _(spark, folder):
    trials = materialize(repaired(spark, folder).select("conf", *T.COMBO, "config").distinct())
    width = config_width(trials)
    padded = trials.withColumn("config", S.pad(F.col("config"), width))
    encoded = encode_config(padded, _router(width), "config")
    return encoded.select("conf", *T.COMBO, F.size("encoded").alias("dim"), S.fixed_point(F.col("encoded")).alias("encoded"))


@query("m7_gate_training")
def _(spark, folder):
    _, stats, members = sampled(spark, folder)
    vectors = query_vectors(spark, folder, stats.select(*T.QUERY).distinct())
    pooled = E.mean_max_std(members.join(vectors, T.QUERY))
    best = W.workload_best(W.covered_combos(members, stats))
    rows = materialize(pooled.join(best, "workload_id"))
    out = rows.select("workload_id", *T.COMBO, "pooled")
    for gate in ("engine", "lake"):
        model = M.train_gate(rows, f"{gate}_id", 3 * 64, max_iter=20)
        features = M.array_to_vector("pooled")
        out = model.setFeaturesCol("features").setPredictionCol(f"{gate}_pred").transform(out.withColumn("features", features))
        out = out.drop("features", "rawPrediction", "probability")
    return out.select("workload_id", *T.COMBO, F.col("engine_pred").cast("int").alias("engine_pred"), F.col("lake_pred").cast("int").alias("lake_pred"))
