"""Queries whose models are fitted on the trial log: plan vectors, gates, experts, recommendation, sweep.

A quarter of the log's configurations, chosen by a hash, are probe runs: what is known of a query before
anything is recommended. Queries without a plan get their vector from them. Everything else, training and
evaluation, uses the other runs, split by query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.functions.catalog import SWEEP
from lakewright.operators import features as X
from lakewright.operators import learning as M
from lakewright.operators import pooling as E
from lakewright.operators import recommend as R
from lakewright.operators import trials as T
from lakewright.operators import workloads as W
from lakewright.operators.mapping import fallback_vectors, latency_profiles, map_queries, with_fallback
from lakewright.operators.mixture import Epoch, train
from lakewright.operators.regression import dot, fit_ridge, sketch
from lakewright.operators.routing import Router, gate_choice, score_every, score_routed, score_soft
from lakewright.operators.skew import lookup, split_scan
from lakewright.operators.treeconv import KERNELS, needed_trees, plan_embeddings, seeded_layers
from lakewright.plans import sqltext as Q
from lakewright.plans.plan_log import plan_features
from lakewright.plans.registry import query
from lakewright.plans.trial_log import repaired
from lakewright.session import materialize, written_by
from lakewright.sources.derived import QUERY_PLANS_SQL, query_plan_files

PROBES = 4  # one of so many configurations is a probe run
SKETCH = 24
PENALTIES = (1.0, 100.0)


def is_probe():
    return F.pmod(F.xxhash64(*T.RECORD, "conf"), F.lit(PROBES)) == 0


def query_embeddings(trials: DataFrame, files: DataFrame, features: DataFrame) -> DataFrame:
    """(benchmark, query_id, is_fallback, embedding) of every query of the log.

    A query takes the root vector of the plan it is mapped to, else a vector estimated from its probe runs.
    Only plans that some query is mapped to are convolved.
    """
    queries = T.query_ids(trials)
    mapping = materialize(map_queries(queries, files.select(F.split_part("file_name", F.lit("_plan"), F.lit(1)).alias("plan_key"))))
    trees = needed_trees(X.common_width(features), mapping)
    width = trees.agg(F.max(F.size(F.get("features", F.lit(0))))).first()[0] or 0
    embeddings = materialize(plan_embeddings(trees, seeded_layers([3 * width, 256, 128, KERNELS * width])))
    known = lookup(mapping.where("plan_key IS NOT NULL"), embeddings, ["plan_key"], "inner")
    profiles = latency_profiles(W.combo_stats(trials.where(is_probe())))
    none = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), 9))
    profiles = queries.join(profiles, T.QUERY, "left").withColumn("profile", F.coalesce("profile", none))
    return materialize(with_fallback(mapping, embeddings, fallback_vectors(profiles, known)))


@dataclass(frozen=True)
class Setup:
    """The whole log, the runs to learn from and to choose from, the vectors of the queries and their split."""

    log: DataFrame
    trials: DataFrame
    stats: DataFrame
    vectors: DataFrame
    splits: DataFrame
    width: int

    def of(self, *parts: str) -> DataFrame:
        return self.splits.where(F.col("split").isin(*parts)).select(*T.QUERY)


_setups: dict[tuple, Setup] = {}


def setup(spark, folder: str, files: DataFrame | None = None) -> Setup:
    """Kept per session and folder, as several queries start from it; plan texts of one's own are not kept."""
    key = (*written_by(spark), folder)
    if files is None and key in _setups:
        return _setups[key]
    used = materialize(query_plan_files(spark, folder)) if files is None else files
    log = materialize(repaired(spark, folder))
    vectors = query_embeddings(log, used, materialize(plan_features(spark, folder, used)))
    vectors = materialize(sketch(vectors, "embedding", SKETCH, "sketch"))
    trials = materialize(log.where(~is_probe()))
    stats = materialize(W.combo_stats(trials))
    splits = materialize(T.split_queries(stats.select(*T.QUERY).distinct()))
    made = Setup(log, trials, stats, vectors, splits, T.max_width(trials).first()[0] or 0)
    if files is None:
        _setups[key] = made
    return made


_MAPPED = r"""q AS (SELECT DISTINCT benchmark, query_id, regexp_replace(query_id, '^sf\d+_', '') AS base FROM accepted),
plan_texts AS ({plans}), keys AS (SELECT split_part(file_name, '_plan', 1) AS plan_key FROM plan_texts),
cands AS (
  SELECT benchmark, query_id, 1 AS choice, 'tpcds_q' || replace(substr(base, 6), '_', '') AS plan_key FROM q WHERE starts_with(base, 'query')
  UNION ALL SELECT benchmark, query_id, 2, 'ssb_Q' || regexp_extract(base, '^q(\d+)_(\d+)$', 1) || '.' || regexp_extract(base, '^q(\d+)_(\d+)$', 2) FROM q WHERE regexp_matches(base, '^q(\d+)_(\d+)$')
  UNION ALL SELECT benchmark, query_id, 3, base FROM q WHERE starts_with(base, 'job_')
  UNION ALL SELECT benchmark, query_id, 4, 'tpch_0_' || base FROM q WHERE regexp_matches(base, '^q\d+$')
  UNION ALL SELECT benchmark, query_id, 5, 'tpcds_' || base FROM q WHERE regexp_matches(base, '^q\d+$')),
mapped AS (SELECT benchmark, query_id, arg_min(plan_key, choice) AS plan_key FROM cands WHERE plan_key IN (SELECT plan_key FROM keys) GROUP BY 1, 2)""".replace("{plans}", QUERY_PLANS_SQL)


@query(
    "j6_fallback_queries",
    Q.with_(Q.RAW, Q.ACCEPTED, _MAPPED, select="""SELECT benchmark, query_id, mapped.plan_key IS NULL AS is_fallback, 1.0::double AS spread
      FROM q LEFT JOIN mapped USING (benchmark, query_id)"""),
)
def _(spark, folder):
    """Every query has a normalised vector, that of its plan or an estimated one."""
    e = F.col("embedding")
    spread = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x) / F.size(e))
    return setup(spark, folder).vectors.select(*T.QUERY, "is_fallback", F.round(spread, 2).alias("spread"))


@query("m2_plan_embeddings")
def _(spark, folder):
    rows = setup(spark, folder).vectors
    return rows.select(
        *T.QUERY, "is_fallback", F.size("embedding").alias("dim"), S.fixed_point(F.col("embedding")).alias("embedding")
    )


KNOTS = (0.0, 1.0, 3.0, 6.0, 12.0, 25.0)


def expert_inputs(width: int):
    """1, each entry of the configuration above each knot, as a logarithm and its sign, and the query's sketch."""
    config = F.slice(S.pad(F.col("config"), width), 1, width)
    above = F.flatten(F.transform(config, lambda x: F.array(*[F.greatest(x - k, F.lit(0.0)) / 10.0 for k in KNOTS])))
    logs = F.flatten(F.transform(config, lambda x: F.array(F.log1p(F.abs(x)), F.signum(x))))
    return F.concat(F.array(F.lit(1.0)), above, logs, F.col("sketch"))


def expert_records(s: Setup, queries: DataFrame, sample: bool) -> DataFrame:
    """Runs of these queries with their sketch, ratio and its logarithm."""
    runs = W.quantile_sample(s.trials) if sample else s.trials.withColumn("copies", F.lit(1))
    known = lookup(runs, s.vectors.join(queries, T.QUERY).select(*T.QUERY, "sketch"), T.QUERY, "inner")
    ratio = W.with_ratio(known, W.query_best(s.stats), cap=None)
    return ratio.withColumn("inputs", expert_inputs(s.width)).withColumn("target", F.log("ratio"))


def train_experts(records: DataFrame, keys: list[str], penalty: float) -> DataFrame:
    """One ratio model per group of ``keys``, all in one job; a table of models."""
    return fit_ridge(records, keys, F.col("inputs"), F.array("target"), F.col("copies"), penalty)


def expert_scores(records: DataFrame, experts: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted log ratio of each run by the model of its group; a run without a model comes last."""
    models = experts.select(*keys, F.get("coefficients", F.lit(0)).alias("beta"))
    return lookup(records, models, keys).withColumn(
        "pred", F.coalesce(dot(F.col("inputs"), F.col("beta")), F.lit(float(1 << 60)))
    )


@query("m8_expert_training")
def _(spark, folder):
    """Per combo: records its own expert learned from, and its squared errors of the log ratio."""
    s = setup(spark, folder)
    experts = materialize(train_experts(expert_records(s, s.of("train"), True), T.COMBO, PENALTIES[0]))
    others = expert_scores(expert_records(s, s.of("valid", "test"), True), experts, T.COMBO)
    error = F.sum(F.col("copies") * (F.col("pred") - F.col("target")) ** 2) / F.sum("copies")
    held_out = others.groupBy(*T.COMBO).agg(F.sum("copies").alias("n_held_out"), F.round(error, 4).alias("held_out_mse"))
    rows = experts.select(*T.COMBO, F.col("n").cast("long").alias("n_records"), F.round(F.get("mse", F.lit(0)), 4).alias("mse"))
    return rows.join(held_out, T.COMBO, "left")


def workload_rows(s: Setup, wanted: int = 1000, seed: int = 42) -> DataFrame:
    """Pooled sketches of sampled training workloads, with each one's best combo."""
    members = materialize(W.sample_workloads(s.of("train"), s.stats, wanted, seed=seed))
    pooled = E.mean_max_std(members.join(s.vectors.select(*T.QUERY, F.col("sketch").alias("embedding")), T.QUERY))
    return pooled.join(W.workload_best(W.covered_combos(members, s.stats)), "workload_id")


def learned_gates(rows: DataFrame, asked: DataFrame, dim: int) -> DataFrame:
    """``asked`` with the engine and lake that gates trained on the workloads' best combos choose."""
    out = asked
    for gate in ("engine", "lake"):
        model = M.train_gate(rows, f"{gate}_id", dim, max_iter=20).setPredictionCol(f"{gate}_star")
        features = M.array_to_vector("pooled")
        out = model.setFeaturesCol("features").transform(out.withColumn("features", features))
        out = out.withColumn(f"{gate}_star", F.col(f"{gate}_star").cast("int")).drop("features", "rawPrediction", "probability")
    return out


def learned_picks(s: Setup, penalties: tuple[float, ...] = PENALTIES) -> DataFrame:
    """Picks of the test queries: plan vectors, trained gates, candidates, an expert per combo, lowest prediction.

    Gates learn from the training workloads, the nine experts from the sampled runs of training queries. The
    penalty with the lowest mean ratio on the validation queries is taken.
    """
    # A query to place is a workload of its own.
    asked = s.vectors.join(s.of("valid", "test"), T.QUERY).withColumn("one", F.struct(*T.QUERY))
    pooled = E.mean_max_std(asked.withColumn("embedding", F.col("sketch")), "one").select("one.*", "pooled")
    chosen = materialize(learned_gates(materialize(workload_rows(s)), pooled, 3 * SKETCH).drop("pooled"))
    known = materialize(expert_records(s, s.of("train"), True))
    open_runs = materialize(expert_records(s, s.of("valid", "test"), False))
    tried = []
    for penalty in penalties:
        scored = expert_scores(open_runs, train_experts(known, T.COMBO, penalty), T.COMBO)
        found = materialize(R.pick_per_query(scored, chosen).join(s.splits, T.QUERY))
        tried.append((found.where("split = 'valid'").agg(F.avg("ratio")).first()[0] or 0.0, penalty, found))
    best = min(tried, key=lambda t: t[:2])[2]
    return best.where("split = 'test'").drop("split").join(s.vectors.select(*T.QUERY, "is_fallback"), T.QUERY)


@query("m9_learned_recommendation")
def _(spark, folder):
    """Per test query: engine, lake and configuration that trained gates and experts choose, and the regret."""
    return learned_picks(setup(spark, folder)).select(
        *T.QUERY, "is_fallback", "pick_engine_id", "pick_lake_id", "pick_conf", "fallback", F.round("ratio", 4).alias("ratio")
    )


def random_ratio(s: Setup) -> DataFrame:
    """Per test query the expected ratio of a run picked at random."""
    runs = lookup(s.trials, s.of("test"), T.QUERY, "inner")
    return runs.groupBy(*T.QUERY).agg((F.avg("latency") / F.min("latency")).alias("random_ratio"))


@query("m9_learned_metrics")
def _(spark, folder):
    """Mean ratio on the test queries, for queries with a plan and for those with an estimated vector."""
    s = setup(spark, folder)
    rows = learned_picks(s).join(random_ratio(s), T.QUERY)
    engine, lake = (F.col(f"pick_{c}") == F.col(f"best_{c}") for c in T.COMBO)
    return rows.groupBy("is_fallback").agg(
        F.count("*").alias("n"),
        F.round(F.avg("ratio"), 4).alias("mean_ratio"),
        F.round(F.avg("random_ratio"), 4).alias("random_ratio"),
        F.round(F.avg((engine & lake).cast("int")), 4).alias("combo_acc"),
    )


PAIR = ["benchmark", "sf"]


def pair_splits(s: Setup) -> DataFrame:
    """(benchmark, sf, query_id, split) of the sweep's pairs: each pair is split on its own."""
    scale = F.substring_index(F.expr("substring(query_id, 3)"), "_", 1)
    pairs = F.array(*[F.lit(f"{b}|{sf}") for b, sf in SWEEP])
    queries = s.splits.select(*T.QUERY, scale.alias("sf")).where(F.array_contains(pairs, F.concat_ws("|", *PAIR)))
    keyed = queries.withColumn("_h", F.md5(F.concat_ws(":", F.lit("42"), *T.QUERY)))
    ranked = split_scan(keyed, PAIR, ["_h", "query_id"], out="rank", total="n")
    train, valid = F.floor(F.col("n") * 0.70), F.floor(F.col("n") * 0.15)
    part = F.when(F.col("rank") < train, "train").when(F.col("rank") < train + valid, "valid").otherwise("test")
    return ranked.select(*PAIR, "query_id", part.alias("split"))


@query(
    "m12_pair_splits",
    Q.with_(
        Q.RAW, Q.ACCEPTED,
        f"""pairs AS (SELECT * FROM (VALUES {", ".join(f"('{b}', '{s}')" for b, s in SWEEP)}) v(benchmark, sf)),
        runs AS (SELECT DISTINCT benchmark, query_id, split_part(substr(query_id, 3), '_', 1) AS sf FROM accepted),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY benchmark, sf ORDER BY md5('42:' || benchmark || ':' || query_id), query_id) - 1 AS rk,
          count(*) OVER (PARTITION BY benchmark, sf) AS n FROM runs JOIN pairs USING (benchmark, sf))""",
        select="""SELECT benchmark, sf, CASE WHEN rk < floor(n * 0.7::double) THEN 'train'
          WHEN rk < floor(n * 0.7::double) + floor(n * 0.15::double) THEN 'valid' ELSE 'test' END AS split, count(*) AS n_queries FROM ranked GROUP BY ALL""",
    ),
)
def _(spark, folder):
    return pair_splits(setup(spark, folder)).groupBy(*PAIR, "split").agg(F.count("*").alias("n_queries"))


def trained_sweep(s: Setup, penalty: float = 10.0) -> DataFrame:
    """One row per pair of the sweep: gates and experts trained on its own training queries, tested on its own.

    The gates are regressions of the best engine and lake on the query's sketch, the experts regressions of
    the log ratio, keyed by pair (and combo): all pairs train in one job each.
    """
    splits = materialize(pair_splits(s))
    queries = splits.join(s.vectors.select(*T.QUERY, "sketch"), T.QUERY)
    best = W.query_best(s.stats).select(*T.QUERY, "best_engine_id", "best_lake_id")
    labels = queries.join(best, T.QUERY)
    one = F.concat(F.array(F.lit(1.0)), F.col("sketch"))
    hot = F.concat(S.one_hot(F.col("best_engine_id"), M.CLASSES), S.one_hot(F.col("best_lake_id"), M.CLASSES))
    gates = fit_ridge(labels.where("split = 'train'"), PAIR, one, hot, penalty=penalty)
    asked = queries.where("split = 'test'").join(gates.select(*PAIR, "coefficients"), PAIR)
    logits = F.transform("coefficients", lambda beta: dot(one, beta))
    chosen = materialize(R.choose_combo(asked.withColumn("logits", logits), F.slice("logits", 1, 3), F.slice("logits", 4, 3)))
    keys = [*PAIR, *T.COMBO]

    def records(part: str, sample: bool) -> DataFrame:
        of_part = splits.where(F.col("split") == part)
        rows = expert_records(s, of_part.select(*T.QUERY), sample)
        return rows.drop("sf").withColumn("sf", F.substring_index(F.expr("substring(query_id, 3)"), "_", 1))

    experts = materialize(train_experts(records("train", True), keys, penalty))
    picks = R.pick_per_query(expert_scores(records("test", False), experts, keys), chosen)
    tested = R.query_metrics(picks.join(splits, T.QUERY), by=PAIR)
    models = experts.groupBy(*PAIR).agg(F.count("*").alias("n_experts"), F.sum("n").cast("long").alias("n_records"))
    every = s.vectors.sparkSession.createDataFrame(SWEEP, "benchmark string, sf string")
    return every.join(tested, PAIR, "left").join(models, PAIR, "left")


@query("m12_trained_sweep")
def _(spark, folder):
    rows = trained_sweep(setup(spark, folder))
    names = ["mean_ratio", "engine_acc", "lake_acc", "combo_acc"]
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "n_fallback", "n_experts", "n_records")]
    return rows.select(*PAIR, *[F.round(c, 4).alias(c) for c in names], *counts)


WIDTH = 32  # of every hidden layer of the fitted mixture


def knobs(config, width: int):
    """A configuration of fixed length with the size of large entries reduced."""
    return F.transform(F.slice(S.pad(config, width), 1, width), lambda x: F.signum(x) * F.log1p(F.abs(x)))


def mixture_rows(s: Setup) -> DataFrame:
    """Training rows of the mixture: the best run of each training query and its sampled runs."""
    sampled = expert_records(s, s.of("train"), True).select(
        F.col("sketch").alias("emb"), knobs(F.col("config"), s.width).alias("conf"), *T.COMBO,
        "target", F.col("copies").cast("double").alias("weight"), F.lit(3).alias("kind"),
    )
    best = W.query_best(s.stats).join(s.of("train"), T.QUERY).join(s.vectors.select(*T.QUERY, "sketch"), T.QUERY)
    best = best.select(
        F.col("sketch").alias("emb"), knobs(F.col("best_config"), s.width).alias("conf"), F.col("best_engine_id").alias("engine_id"),
        F.col("best_lake_id").alias("lake_id"), F.lit(0.0).alias("target"), F.lit(1.0).alias("weight"), F.lit(1).alias("kind"),
    )
    return best.unionByName(sampled)


def open_runs(s: Setup, part: str) -> DataFrame:
    """Lowest latency per configuration of a part's queries, with vectors."""
    runs = s.trials.groupBy(*T.RECORD, "conf").agg(F.min("latency").alias("latency"))
    runs = lookup(runs, s.vectors.join(s.of(part), T.QUERY).select(*T.QUERY, "sketch"), T.QUERY, "inner")
    config = S.config_vector(F.col("conf"), F.col("engine_id"), F.col("lake_id"))
    return runs.withColumn("knobs", knobs(config, s.width))


def mixture_picks(s: Setup, router: Router, runs: DataFrame, part: str) -> DataFrame:
    """The gates' combo, then the configuration with the lowest oracle-routed prediction."""
    gated = gate_choice(s.vectors.join(s.of(part), T.QUERY), router, "sketch")
    chosen = R.choose_combo(gated, F.col("engine_logits"), F.col("lake_logits"))
    return R.pick_per_query(score_routed(runs, router, "sketch", "knobs", F.col("engine_id"), F.col("lake_id")), chosen)


_fits: dict[tuple, tuple[Router, list[Epoch]]] = {}


def fitted(spark, folder: str) -> tuple[Router, list[Epoch]]:
    """The fitted mixture and its epochs, kept per session and folder."""
    key = (*written_by(spark), folder)
    if key not in _fits:
        s = setup(spark, folder)
        runs = materialize(open_runs(s, "valid"))

        def validate(router: Router) -> float:
            return mixture_picks(s, router, runs, "valid").agg(F.avg("ratio")).first()[0] or 0.0

        start = Router.seeded(SKETCH, s.width, width=WIDTH)
        _fits[key] = train(materialize(mixture_rows(s)), start, validate, epochs=4, passes=6)
    return _fits[key]


def whole_log(s: Setup) -> DataFrame:
    """Every record of the repaired log with its query's sketch and its configuration."""
    records = lookup(s.log, s.vectors.select(*T.QUERY, "sketch"), T.QUERY, "inner")
    return records.withColumn("knobs", knobs(F.col("config"), s.width))


@query("m4_soft_routed_score")
def _(spark, folder):
    scored = score_soft(whole_log(setup(spark, folder)), fitted(spark, folder)[0], "sketch", "knobs")
    return scored.select(
        *T.RECORD, "conf", F.round("scored.pred", 4).alias("pred"), S.fixed_point(F.col("scored.engine_logits")).alias("engine_logits")
    )


@query("m5_hard_routed_score")
def _(spark, folder):
    s, router = setup(spark, folder), fitted(spark, folder)[0]
    # The gates look at the query only, so they run once per query.
    gated = gate_choice(s.vectors, router, "sketch")
    stars = R.choose_combo(gated, F.col("engine_logits"), F.col("lake_logits"))
    records = lookup(whole_log(s), stars, T.QUERY, "inner")
    scored = score_routed(records, router, "sketch", "knobs", F.col("engine_star"), F.col("lake_star"))
    return scored.select(*T.RECORD, "conf", F.round("pred", 4).alias("pred"))


@query("m6_oracle_routed_score")
def _(spark, folder):
    scored = score_routed(
        whole_log(setup(spark, folder)), fitted(spark, folder)[0], "sketch", "knobs", F.col("engine_id"), F.col("lake_id")
    )
    return scored.select(*T.RECORD, "conf", F.round("pred", 4).alias("pred"))


@query(
    "m6_equals_m5_per_combo",
    Q.with_(Q.RAW, Q.ACCEPTED, select="SELECT engine_id, lake_id, count(*) AS n, true AS agree FROM accepted GROUP BY ALL"),
)
def _(spark, folder):
    """Routing every record to a given combo gives, for that combo's records, what routing to their own gives."""
    records, router = whole_log(setup(spark, folder)), fitted(spark, folder)[0]
    scored = score_routed(records, router, "sketch", "knobs", F.col("engine_id"), F.col("lake_id"))
    scored = score_every(scored, router, "sketch", "knobs")
    given = F.get("preds", F.col("engine_id") * M.CLASSES + F.col("lake_id"))
    return scored.groupBy(*T.COMBO).agg(F.count("*").alias("n"), F.bool_and(F.abs(given - F.col("pred")) < 1e-9).alias("agree"))


@query("m11_training_epochs")
def _(spark, folder):
    """Losses and validation ratio of every epoch of the mixture's training, and which epoch was kept."""
    _, epochs = fitted(spark, folder)
    rows = spark.createDataFrame([(e.epoch, e.s1, e.mse, e.ce, e.div, e.s3, e.valid_ratio) for e in epochs], "epoch int, s1 double, mse double, ce double, div double, s3 double, valid_ratio double")
    best = F.min(F.struct("valid_ratio", "epoch")).over(Window.partitionBy())  # a row per epoch
    return rows.select(
        "epoch", *[F.round(c, 4).alias(c) for c in ("s1", "mse", "ce", "div", "s3", "valid_ratio")], (best["epoch"] == F.col("epoch")).alias("kept")
    )


@query("m11_mixture_test")
def _(spark, folder):
    """The one test run of the kept mixture: mean ratio and accuracies over the test queries."""
    s, router = setup(spark, folder), fitted(spark, folder)[0]
    metrics = R.query_metrics(mixture_picks(s, router, materialize(open_runs(s, "test")), "test"))
    return metrics.select(*[F.round(c, 4).alias(c) for c in ("mean_ratio", "engine_acc", "lake_acc", "combo_acc")], "n", "n_fallback")


def workload_inputs(s: Setup, wanted: int = 50, seed: int = 8) -> tuple[DataFrame, DataFrame]:
    """Sampled test workloads and their vectors: the mean of their queries' sketches."""
    members = materialize(W.sample_workloads(s.of("test"), s.stats, wanted, seed=seed))
    spread = members.join(s.vectors.select(*T.QUERY, F.posexplode("sketch").alias("d", "v")), T.QUERY)
    means = spread.groupBy("workload_id", "d").agg(F.avg("v").alias("v")).groupBy("workload_id")
    pooled = means.agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("c"))
    return members, materialize(pooled.select("workload_id", F.transform("c", lambda c: c["v"]).alias("sketch")))


def mixture_workload_picks(s: Setup, router: Router, members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per workload the record with the lowest oracle-routed prediction over all records of its queries."""
    runs = W.workload_records(members, open_runs(s, "test").drop("sketch"))
    rows = runs.join(F.broadcast(vectors), "workload_id")  # a row per workload, ``wanted`` at most
    scored = score_routed(rows, router, "sketch", "knobs", F.col("engine_id"), F.col("lake_id"))
    record = F.struct("pred", *T.COMBO, *T.QUERY, "conf", "latency")
    picked = scored.groupBy("workload_id").agg(F.min(record).alias("p"), F.min("latency").alias("pool_best"))
    names = [F.col(f"p.{c}").alias(f"pick_{c}") for c in (*T.COMBO, *T.QUERY, "conf")]
    return picked.select("workload_id", *names, (F.col("p.latency") / F.col("pool_best")).alias("ratio"))


@query("m10_learned_recommendation")
def _(spark, folder):
    s = setup(spark, folder)
    rows = mixture_workload_picks(s, fitted(spark, folder)[0], *workload_inputs(s))
    return rows.withColumn("ratio", F.round("ratio", 4))


def _metrics(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) for c in ("mean_ratio", "engine_acc", "lake_acc", "combo_acc") if c in df.columns], "n")


@query("a11_learned_metrics")
def _(spark, folder):
    s = setup(spark, folder)
    members, vectors = workload_inputs(s)
    best = W.workload_best(W.covered_combos(members, s.stats))
    return _metrics(R.workload_metrics(mixture_workload_picks(s, fitted(spark, folder)[0], members, vectors), best))


@query("a12_learned_gates")
def _(spark, folder):
    s = setup(spark, folder)
    members, vectors = workload_inputs(s)
    gated = gate_choice(vectors, fitted(spark, folder)[0], "sketch")
    choices = gated.select("workload_id", S.argmax(F.col("engine_logits")).alias("engine_star"), S.argmax(F.col("lake_logits")).alias("lake_star"))
    return _metrics(R.gate_accuracy(choices, W.workload_best(W.covered_combos(members, s.stats))))
