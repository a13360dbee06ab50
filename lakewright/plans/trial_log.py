"""Queries over the trial log: cleaning, pooling, repair, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.operators import trials as T
from lakewright.plans import sqltext as Q
from lakewright.plans.registry import query
from lakewright.sources import trial_csv
from lakewright.sources.derived import trials_raw


def accepted(spark, folder):
    return T.normalise(trials_raw(spark, folder))


def repaired(spark, folder):
    return T.repair(accepted(spark, folder))


@query(
    "s1_trial_csv_scan",
    Q.with_(Q.RAW, select="SELECT nullif(sf, '') AS sf, engine, datalake, query_name, conf, latency FROM trials_raw"),
)
def _(spark, folder):
    root = trial_csv.write_trials(trials_raw(spark, folder).withColumn("benchmark", F.lit("ssb_flat")), ["ssb_flat"])
    return trial_csv.read_trials(spark, root, "ssb_flat").select(
        "sf", "engine", "datalake", "query_name", "conf", "latency"
    )


@query(
    "s2_benchmark_directory",
    Q.with_(Q.RAW, select="SELECT benchmark, count(*) AS n_rows FROM trials_raw WHERE benchmark <> 'job' GROUP BY 1"),
)
def _(spark, folder):
    root = trial_csv.write_trials(trials_raw(spark, folder).where("benchmark <> 'job'"), ["tpch", "tpcds", "ssb"])
    logs = [trial_csv.read_trials(spark, root, b) for b in ("tpch", "tpcds", "ssb", "job")]
    return T.pool(logs).groupBy("benchmark").agg(F.count("*").alias("n_rows"))


@query(
    "s3_rows_per_file",
    Q.with_(Q.RAW, Q.ACCEPTED, select="SELECT file_name, count(*) AS n_rows FROM accepted GROUP BY 1"),
)
def _(spark, folder):
    return T.rows_per_file(accepted(spark, folder))


@query(
    "t1_valid_trials",
    Q.with_(
        Q.RAW,
        select="""SELECT engine, datalake, query_name, sf, try_cast(trim(latency) AS double) AS latency FROM trials_raw
        WHERE try_cast(trim(latency) AS double) >= 1500 AND trim(engine) <> '' AND trim(datalake) <> ''
          AND trim(query_name) <> '' AND trim(sf) <> ''""",
    ),
)
def _(spark, folder):
    return T.accept(trials_raw(spark, folder)).select("engine", "datalake", "query_name", "sf", "latency")


@query(
    "t2_combo_ids",
    Q.with_(Q.RAW, Q.ACCEPTED, select="SELECT engine_id, lake_id, count(*) AS n_rows FROM accepted GROUP BY 1, 2"),
)
def _(spark, folder):
    return accepted(spark, folder).groupBy("engine_id", "lake_id").agg(F.count("*").alias("n_rows"))


@query(
    "t3_query_id",
    Q.with_(Q.RAW, Q.ACCEPTED, select="SELECT benchmark, query_id, sf, count(*) AS n_rows FROM accepted GROUP BY ALL"),
)
def _(spark, folder):
    return accepted(spark, folder).groupBy("benchmark", "query_id", "sf").agg(F.count("*").alias("n_rows"))


_HALVES = r"""SELECT conf, count(*) AS n_rows,
  {engine} AS engine_conf, {lake} AS lake_conf FROM trials_raw WHERE {where} GROUP BY conf"""


@query(
    "t4_conf_pipe_form",
    Q.with_(
        Q.RAW,
        select=_HALVES.format(
            engine=Q.fixed("list_transform(string_split(split_part(conf, '|', 1), ';'), lambda x: cast(x AS double))"),
            lake=Q.fixed("list_transform(string_split(split_part(conf, '|', 2), ';'), lambda x: cast(x AS double))"),
            where="contains(conf, '|')",
        ),
    ),
)
def _(spark, folder):
    return _halves(trials_raw(spark, folder).where(F.contains("conf", F.lit("|"))))


@query(
    "t5_conf_knob_form",
    Q.with_(
        Q.RAW,
        select=_HALVES.format(
            engine=Q.fixed(
                "list_transform(string_split(conf, ';'), lambda x: coalesce(try_cast(regexp_replace("
                "regexp_replace(trim(x), '[a-zA-Z]+$', ''), '^[^=]*=', '') AS double), 0.0::double))"
            ),
            lake="'0'",
            where="NOT contains(conf, '|')",
        ),
    ),
)
def _(spark, folder):
    return _halves(trials_raw(spark, folder).where(~F.contains("conf", F.lit("|"))))


def _halves(raw):
    halves = S.config_halves(F.col("conf"))
    return (
        raw.groupBy("conf")
        .agg(F.count("*").alias("n_rows"))
        .select(
            "conf",
            "n_rows",
            S.fixed_point(halves["engine"]).alias("engine_conf"),
            S.fixed_point(halves["lake"]).alias("lake_conf"),
        )
    )


@query(
    "t6_config_vector",
    Q.with_(
        Q.RAW, Q.ACCEPTED,
        select=f"SELECT benchmark, query_id, conf, {Q.fixed('config')} AS config, latency FROM accepted",
    ),
)
def _(spark, folder):
    return accepted(spark, folder).select(
        "benchmark", "query_id", "conf", S.fixed_point(F.col("config")).alias("config"), "latency"
    )


@query(
    "t7_config_padding",
    Q.with_(
        Q.RAW, Q.ACCEPTED,
        select=f"""SELECT benchmark, query_id, latency,
          {Q.fixed("list_resize(config, 8, 0.0::double)")} AS wide, {Q.fixed("list_resize(config, 4, 0.0::double)")} AS narrow
          FROM accepted""",
    ),
)
def _(spark, folder):
    return accepted(spark, folder).select(
        "benchmark",
        "query_id",
        "latency",
        S.fixed_point(S.pad(F.col("config"), 8)).alias("wide"),
        S.fixed_point(S.pad(F.col("config"), 4)).alias("narrow"),
    )


@query(
    "t8_scale_filter",
    Q.with_(
        Q.RAW, Q.ACCEPTED,
        select="SELECT query_id, count(*) AS n_rows FROM accepted WHERE query_id LIKE 'sf10\\_%' ESCAPE '\\' GROUP BY 1",
    ),
)
def _(spark, folder):
    return T.at_scale(accepted(spark, folder), "10").groupBy("query_id").agg(F.count("*").alias("n_rows"))


@query(
    "t9_typed_literal",
    r"""WITH lits AS (
      SELECT CASE o_orderkey % 4 WHEN 0 THEN cast(o_custkey AS varchar)
        WHEN 1 THEN cast(o_custkey AS varchar) || '.5'
        WHEN 2 THEN '19' || cast(90 + o_custkey % 9 AS varchar) || '-0' || cast(o_custkey % 9 + 1 AS varchar) || '-11'
        ELSE o_orderpriority END AS text FROM orders)
    SELECT text, count(*) AS n_rows, CASE WHEN try_cast(text AS bigint) IS NOT NULL AND NOT contains(text, '.') THEN 'int'
      WHEN try_cast(text AS double) IS NOT NULL THEN 'float'
      WHEN regexp_full_match(text, '\d{4}-\d{1,2}-\d{1,2}') AND try_cast(text AS date) IS NOT NULL THEN 'date' ELSE 'string' END AS kind,
      coalesce(try_cast(text AS double), CASE WHEN regexp_full_match(text, '\d{4}-\d{1,2}-\d{1,2}')
        THEN date_diff('day', DATE '1970-01-01', try_cast(text AS date)) END::double) AS num
    FROM lits GROUP BY text""",
)
def _(spark, folder):
    from lakewright.sources.tables import table

    key, cust = F.col("o_orderkey") % 4, F.col("o_custkey")
    text = (
        F.when(key == 0, cust.cast("string"))
        .when(key == 1, F.concat(cust.cast("string"), F.lit(".5")))
        .when(
            key == 2,
            F.concat(F.lit("19"), (cust % 9 + 90).cast("string"), F.lit("-0"), (cust % 9 + 1).cast("string"), F.lit("-11")),
        )
        .otherwise(F.col("o_orderpriority"))
    )
    counted = table(spark, folder, "orders").groupBy(text.alias("text")).agg(F.count("*").alias("n_rows"))
    value = S.parse_literal(F.col("text"))
    return counted.select("text", "n_rows", value["kind"].alias("kind"), value["num"].alias("num"))


@query(
    "t10_floor_repair",
    Q.with_(
        Q.RAW, Q.ACCEPTED, Q.REPAIRED,
        select=f"SELECT {Q.REC}, conf, repaired, round(latency, 4) AS latency FROM repaired",
    ),
)
def _(spark, folder):
    return repaired(spark, folder).select(*T.RECORD, "conf", "repaired", F.round("latency", 4).alias("latency"))


@query(
    "a4_max_config_width",
    Q.with_(Q.RAW, Q.ACCEPTED, select="SELECT max(len(config)) AS max_dim FROM accepted"),
)
def _(spark, folder):
    return T.max_width(accepted(spark, folder))


@query(
    "a5_log_moments",
    Q.with_(
        Q.RAW, Q.ACCEPTED, Q.REPAIRED,
        select="""SELECT benchmark, query_id, engine_id, lake_id, g.n, g.n_floor,
          round(coalesce(loc.mu, overall.mu, ln(10000.0)), 4) AS mu,
          round(coalesce(CASE WHEN loc.sd IS NOT NULL THEN greatest(loc.sd, 0.1::double) END, CASE WHEN overall.sd IS NOT NULL THEN greatest(overall.sd, 0.1::double) END, 0.5::double), 4) AS sigma
        FROM (SELECT benchmark, query_id, engine_id, lake_id, count(*) FILTER (latency <> 1500) AS n,
                count(*) FILTER (latency = 1500) AS n_floor FROM accepted GROUP BY ALL) g
        LEFT JOIN loc USING (benchmark, query_id, engine_id, lake_id)
        LEFT JOIN overall USING (engine_id, lake_id)""",
    ),
)
def _(spark, folder):
    return T.log_moments(accepted(spark, folder)).select(
        *T.RECORD, "n", "n_floor", F.round("mu", 4).alias("mu"), F.round("sigma", 4).alias("sigma")
    )


@query(
    "a6_repaired_rows",
    Q.with_(
        Q.RAW, Q.ACCEPTED, Q.REPAIRED,
        select="SELECT engine_id, lake_id, count(*) FILTER (repaired) AS n_repaired, count(*) AS n_rows FROM repaired GROUP BY 1, 2",
    ),
)
def _(spark, folder):
    return (
        repaired(spark, folder)
        .groupBy(*T.COMBO)
        .agg(F.count_if("repaired").alias("n_repaired"), F.count("*").alias("n_rows"))
    )


@query(
    "a7_data_summary",
    Q.with_(
        Q.RAW, Q.ACCEPTED, Q.REPAIRED, Q.SPLIT,
        select="""SELECT count(*) AS n_queries, count(*) FILTER (split = 'train') AS n_train,
          count(*) FILTER (split = 'valid') AS n_valid, count(*) FILTER (split = 'test') AS n_test,
          (SELECT max(len(config)) FROM repaired) AS max_dim FROM splits""",
    ),
)
def _(spark, folder):
    trials = accepted(spark, folder)
    return T.summary(trials, T.split_queries(T.query_ids(trials)))


@query(
    "w3_query_split",
    Q.with_(Q.RAW, Q.ACCEPTED, Q.REPAIRED, Q.SPLIT, select="SELECT benchmark, query_id, split FROM splits"),
)
def _(spark, folder):
    return T.split_queries(T.query_ids(accepted(spark, folder)))


@query(
    "w10_dense_ids",
    Q.with_(
        Q.RAW, Q.ACCEPTED,
        select="""SELECT benchmark, query_id, row_number() OVER (ORDER BY benchmark, query_id) - 1 AS q_idx
        FROM (SELECT DISTINCT benchmark, query_id FROM accepted)""",
    ),
)
def _(spark, folder):
    return T.dense_ids(T.query_ids(accepted(spark, folder)))


_POOLED = "SELECT query_id, engine_id, lake_id, count(*) AS n_records, cast(sum(latency) AS double) AS total FROM accepted {where} GROUP BY ALL"


@query("j1_pooled_benchmarks", Q.with_(Q.RAW, Q.ACCEPTED, select=_POOLED.format(where="")))
def _(spark, folder):
    raw = trials_raw(spark, folder)
    logs = [T.normalise(raw.where(F.col("benchmark") == b)) for b in ("tpcds", "ssb", "job", "tpch")]
    return _pooled(T.without_benchmark(T.pool(logs)))


@query(
    "j2_supplement_merge",
    Q.with_(Q.RAW, Q.ACCEPTED, select=_POOLED.format(where="WHERE benchmark = 'tpch' OR (benchmark = 'ssb' AND sf <> '10')")),
)
def _(spark, folder):
    raw = trials_raw(spark, folder)
    supply = raw.where("benchmark = 'ssb' AND sf <> '10'").withColumn("benchmark", F.lit("tpch_supply"))
    root = trial_csv.write_trials(raw.where("benchmark = 'tpch'").unionByName(supply), ["tpch", "tpch_supply"])
    return _pooled(T.normalise(trial_csv.read_pooled(spark, root, ["tpch"], use_supply=True)))


def _pooled(trials):
    return trials.groupBy("query_id", *T.COMBO).agg(
        F.count("*").alias("n_records"), F.sum("latency").alias("total")
    )
