"""Queries over embeddings: pooling, losses, fallback, gate choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.operators import losses as L
from lakewright.operators import pooling as E
from lakewright.operators.mapping import with_fallback
from lakewright.plans import sqltext as Q
from lakewright.plans.registry import query
from lakewright.session import materialize
from lakewright.sources.tables import table

DIM = 64
# Score vectors of the attention heads: head h takes the dimensions d with d % 4 = h.
_HEADS = [[(1.0 if d % 4 == h else 0.0) for d in range(DIM)] for h in range(4)]


def members(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("label").alias("workload_id"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding")
    )


_DIMS = "dims AS (SELECT label AS workload_id, vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)"


@query(
    "a19_mean_max_std_pool",
    Q.with_(
        _DIMS,
        """stats AS (SELECT workload_id, d, avg(x) AS m, max(x) AS mx, stddev_pop(x) AS sd FROM dims GROUP BY 1, 2)""",
        select="""SELECT workload_id, d + off * 64 AS pos, round(CASE off WHEN 0 THEN m WHEN 1 THEN mx ELSE sd END, 4) AS value
        FROM stats, range(3) r(off)""",
    ),
)
def _(spark, folder):
    return _positions(E.mean_max_std(members(spark, folder)))


def _positions(pooled):
    rows = pooled.select("workload_id", F.posexplode_outer("pooled").alias("pos", "value"))
    return rows.select("workload_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("value", 4).alias("value"))


@query(
    "a20_attention_pool",
    Q.with_(
        _DIMS,
        """scores AS (SELECT workload_id, vec_id, (d - 1) % 4 AS h, sum(x) AS s FROM dims GROUP BY ALL),
        attn AS (SELECT workload_id, vec_id, h, exp(s - max(s) OVER (PARTITION BY workload_id, h)) AS e FROM scores),
        norm AS (SELECT workload_id, vec_id, h, e / sum(e) OVER (PARTITION BY workload_id, h) AS a FROM attn),
        heads AS (SELECT workload_id, h * 64 + d AS pos, sum(a * x) AS value FROM norm JOIN dims USING (workload_id, vec_id) GROUP BY ALL),
        raw AS (SELECT workload_id, d, avg(x) AS m, max(x) AS mx FROM dims GROUP BY 1, 2)""",
        select="""SELECT workload_id, pos, round(value, 4) AS value FROM heads
        UNION ALL SELECT workload_id, 256 + d, round(m, 4) FROM raw UNION ALL SELECT workload_id, 320 + d, round(mx, 4) FROM raw""",
    ),
)
def _(spark, folder):
    return _positions(E.attention_pool(members(spark, folder), _HEADS, [0.0] * 4))


@query(
    "a21_layer_norm",
    Q.with_(
        _DIMS,
        "s AS (SELECT vec_id, avg(x) AS m, var_pop(x) AS v FROM dims GROUP BY 1)",
        select="SELECT vec_id, d - 1 AS pos, round((x - m) / sqrt(v + 1e-5), 4) AS value FROM dims JOIN s USING (vec_id)",
    ),
)
def _(spark, folder):
    normed = members(spark, folder).select("vec_id", F.posexplode_outer(S.layer_norm(F.col("embedding"))).alias("pos", "value"))
    return normed.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 4).alias("value"))


@query(
    "a17_embedding_spread",
    Q.with_(
        _DIMS,
        """vars AS (SELECT workload_id, avg(v) AS variance FROM (SELECT workload_id, d, var_pop(x) AS v FROM dims GROUP BY 1, 2) GROUP BY 1),
        unit AS (SELECT label, vec_id, embedding::double[] AS e, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS n FROM embeddings),
        cosines AS (SELECT a.label AS workload_id, avg(list_dot_product(a.e, b.e) / ((a.n + 1e-12) * (b.n + 1e-12))) AS cosine
          FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1)""",
        select="SELECT workload_id AS batch_id, round(variance, 4) AS variance, round(cosine, 4) AS cosine, round(cosine - variance, 4) AS spread_loss FROM vars JOIN cosines USING (workload_id)",
    ),
)
def _(spark, folder):
    rows = E.spread(members(spark, folder).withColumnRenamed("workload_id", "batch_id"))
    return rows.select("batch_id", *[F.round(c, 4).alias(c) for c in ("variance", "cosine", "spread_loss")])


@query(
    "w6_gate_argmax",
    """SELECT vec_id, (list_position(embedding[1:3], list_max(embedding[1:3])) - 1)::int AS engine_id,
      (list_position(embedding[4:6], list_max(embedding[4:6])) - 1)::int AS lake_id FROM embeddings""",
)
def _(spark, folder):
    e = F.col("embedding")
    return table(spark, folder, "embeddings").select(
        "vec_id", S.argmax(F.slice(e, 1, 3)).alias("engine_id"), S.argmax(F.slice(e, 4, 3)).alias("lake_id")
    )


@query(
    "j6_fallback_embedding",
    Q.with_(
        """own AS (SELECT label, vec_id, embedding::double[] AS e FROM embeddings),
        chosen AS (SELECT a.vec_id AS query, b.vec_id IS NULL AS is_fallback, coalesce(b.e, a.e) AS e
          FROM own a LEFT JOIN own b ON b.vec_id = a.vec_id + 1 AND b.vec_id % 3 = 0),
        x AS (SELECT query, is_fallback, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM chosen),
        s AS (SELECT query, avg(x) AS m, var_pop(x) AS v FROM x GROUP BY 1)""",
        select="SELECT query, is_fallback, d - 1 AS pos, round((x - m) / sqrt(v + 1e-5), 4) AS value FROM x JOIN s USING (query)",
    ),
)
def _(spark, folder):
    rows = members(spark, folder)
    name = F.concat(F.lit("q"), F.col("vec_id").cast("string"))
    queries = rows.select(F.lit("all").alias("benchmark"), name.alias("query_id"), (F.col("vec_id") + 1).cast("string").alias("plan_key"))
    own = rows.select(F.lit("all").alias("benchmark"), name.alias("query_id"), F.col("embedding").alias("own_embedding"))
    plans = rows.where("vec_id % 3 = 0").select(F.col("vec_id").cast("string").alias("plan_key"), "embedding")
    merged = with_fallback(queries, plans, own)
    out = merged.select(
        F.expr("substring(query_id, 2)").cast("bigint").alias("query"), "is_fallback", F.posexplode_outer("embedding").alias("pos", "value")
    )
    return out.select("query", "is_fallback", F.col("pos").cast("bigint").alias("pos"), F.round("value", 4).alias("value"))


# Scored records: each vector is a record, its first six entries are the gate logits.
_RECORDS = """recs AS (
  SELECT vec_id, label AS batch_id, vec_id % 7 AS workload_id, embedding[1:3]::double[] AS el, embedding[4:6]::double[] AS ll,
    embedding[7]::double + 1 AS pred, 1.0::double AS target, (vec_id % 3)::int AS engine_id, ((vec_id // 3) % 3)::int AS lake_id FROM embeddings),
probs AS (
  SELECT *, list_transform(el, lambda x: exp(x) / list_sum(list_transform(el, lambda y: exp(y)))) AS ep,
    list_transform(ll, lambda x: exp(x) / list_sum(list_transform(ll, lambda y: exp(y)))) AS lp FROM recs),
mse AS (SELECT batch_id, avg(m) AS mse FROM (SELECT batch_id, workload_id, avg((pred - target) ** 2 * ep[engine_id + 1] * lp[lake_id + 1]) AS m
  FROM probs GROUP BY 1, 2) GROUP BY 1),
ce AS (SELECT batch_id, avg(m) AS ce FROM (SELECT batch_id, workload_id, avg(-ln(ep[engine_id + 1]) - ln(lp[lake_id + 1])) AS m
  FROM probs GROUP BY 1, 2) GROUP BY 1),
means AS (SELECT batch_id, gate, c, avg(p) AS p FROM (
    SELECT batch_id, 'e' AS gate, unnest([0, 1, 2]) AS c, unnest(ep) AS p FROM probs UNION ALL SELECT batch_id, 'l', unnest([0, 1, 2]), unnest(lp) FROM probs) GROUP BY ALL),
div AS (SELECT batch_id, sum((p - 1.0 / 3) ** 2) AS div FROM means GROUP BY 1),
gap AS (SELECT batch_id, ln(3.0) + sum(p * ln(p + 1e-12)) FILTER (gate = 'e') AS engine_gap, ln(3.0) + sum(p * ln(p + 1e-12)) FILTER (gate = 'l') AS lake_gap FROM means GROUP BY 1)"""


def records(spark, folder):
    e = F.col("embedding")
    rows = table(spark, folder, "embeddings").withColumn("embedding", e.cast("array<double>"))
    return rows.select(
        "vec_id",
        F.col("label").alias("batch_id"),
        (F.col("vec_id") % 7).alias("workload_id"),
        F.slice(e, 1, 3).alias("engine_logits"),
        F.slice(e, 4, 3).alias("lake_logits"),
        S.softmax(F.slice(e, 1, 3)).alias("engine_probs"),
        S.softmax(F.slice(e, 4, 3)).alias("lake_probs"),
        (F.element_at(e, 7) + 1).alias("pred"),
        F.lit(1.0).alias("target"),
        (F.col("vec_id") % 3).alias("engine_id"),
        (F.floor(F.col("vec_id") / 3) % 3).alias("lake_id"),
        "embedding",
    )


def _rounded(df, *names):
    return df.select("batch_id", *[F.round(n, 4).alias(n) for n in names])


@query("a13_weighted_mse", Q.with_(_RECORDS, select="SELECT batch_id, round(mse, 4) AS mse FROM mse"))
def _(spark, folder):
    return _rounded(L.weighted_mse(records(spark, folder)), "mse")


@query("a14_cross_entropy", Q.with_(_RECORDS, select="SELECT batch_id, round(ce, 4) AS ce FROM ce"))
def _(spark, folder):
    return _rounded(L.cross_entropy(records(spark, folder)), "ce")


@query("a15_balance_loss", Q.with_(_RECORDS, select="SELECT batch_id, round(div, 4) AS div FROM div"))
def _(spark, folder):
    return _rounded(L.balance(L.batch_probs(records(spark, folder))), "div")


@query(
    "a16_entropy_gap",
    Q.with_(_RECORDS, select="SELECT batch_id, round(engine_gap, 4) AS engine_gap, round(lake_gap, 4) AS lake_gap FROM gap"),
)
def _(spark, folder):
    return _rounded(L.entropy_gap(L.batch_probs(records(spark, folder))), "engine_gap", "lake_gap")


@query(
    "a18_total_loss",
    Q.with_(
        _RECORDS,
        _DIMS,
        """vars AS (SELECT workload_id AS batch_id, avg(v) AS variance FROM (SELECT workload_id, d, var_pop(x) AS v FROM dims GROUP BY 1, 2) GROUP BY 1),
        unit AS (SELECT label, vec_id, embedding::double[] AS e, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS n FROM embeddings),
        cosines AS (SELECT a.label AS batch_id, avg(list_dot_product(a.e, b.e) / (a.n * b.n)) AS cosine
          FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1)""",
        select="""SELECT batch_id, round(mse, 4) AS mse, round(ce, 4) AS ce, round(div, 4) AS div, round(engine_gap + lake_gap, 4) AS diversity,
          round(cosine - variance, 4) AS spread_loss, round(mse + ce + 0.1::double * div + engine_gap + lake_gap + 2.0::double * (cosine - variance), 4) AS loss
        FROM mse JOIN ce USING (batch_id) JOIN div USING (batch_id) JOIN gap USING (batch_id) JOIN vars USING (batch_id) JOIN cosines USING (batch_id)""",
    ),
)
def _(spark, folder):
    rows = records(spark, folder)
    losses = L.total_loss(rows, E.spread(rows))
    return _rounded(losses, "mse", "ce", "div", "diversity", "spread_loss", "loss")
