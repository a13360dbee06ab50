"""Trial cleaning, CSV layout, repair, split, workloads and sampling."""

import math

import pytest
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.operators import trials as T
from lakewright.operators import workloads as W
from lakewright.sources import trial_csv
from lakewright.sources.derived import trials_raw


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, value",
    [("1.5", 1.5), (" 7 ", 7.0), ("2e3", 2000.0), ("-.5", -0.5), ("1.5d", None), ("0x10", None), ("nan", None), ("", None), ("1500ms", None)],
)
def test_to_number(spark, text, value):
    assert one(spark, S.to_number(F.lit(text))) == value


@pytest.mark.parametrize(
    "conf, engine, lake",
    [
        ("1;2|3", [1.0, 2.0], [3.0]),
        ("1;;x|3;4", [0.0], [3.0, 4.0]),
        ("1; ;2|", [1.0, 2.0], []),
        ("1|2|3", [1.0], [0.0]),
        ("mem=128MB;n=3", [128.0, 3.0], [0.0]),
        ("a=b=4;;ok=true", [0.0, 0.0, 0.0], [0.0]),
        ("5;6GB", [5.0, 6.0], [0.0]),
    ],
)
def test_config_halves(spark, conf, engine, lake):
    got = one(spark, S.config_halves(F.lit(conf)))
    assert (got.engine, got.lake) == (engine, lake)


@pytest.mark.parametrize(
    "name, expected",
    [("tpch_0_q1", "sf10_q1"), ("ssb_2_q11", "sf10_q11"), ("db1", "sf10_db1"), ("job_10a", "sf10_job_10a"),
     ("query14_a", "sf10_query14_a"), ("q1_1", "sf10_q1_1"), ("tpch_gpt_q132", "sf10_tpch_gpt_q132")],
)
def test_query_id(spark, name, expected):
    assert one(spark, S.query_id(F.lit(name), F.lit("10"))) == expected


def test_pad(spark):
    v = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    assert one(spark, S.pad(v, 2)) == [1.0, 2.0]
    assert one(spark, S.pad(v, 5)) == [1.0, 2.0, 3.0, 0.0, 0.0]


def test_vector_functions(spark):
    v = F.array(F.lit(1.0), F.lit(3.0), F.lit(2.0))
    assert math.isclose(sum(one(spark, S.softmax(v))), 1.0)
    assert one(spark, S.argmax(v)) == 1
    assert math.isclose(one(spark, S.log_sum_exp(v)), math.log(sum(math.exp(x) for x in (1, 3, 2))))
    normed = one(spark, S.layer_norm(v))
    assert abs(sum(normed)) < 1e-9 and math.isclose(sum(x * x for x in normed) / 3, 1.0, rel_tol=1e-4)


RAW = [
    ("b", "f", "spark", "delta", "q1", "1;2|3", "1", "1500"),
    ("b", "f", "spark", "delta", "q1", "1;2|3", "1", "1499.9"),
    ("b", "f", "spark", "delta", "q1", "1;2|3", "1", "oops"),
    ("b", "f", "flink", "delta", "q1", "1;2|3", "1", "9000"),
    ("b", "f", " trino ", "hudi", "q1", "1;2|3", "1", " 2000 "),
    ("b", "f", "presto", "iceberg", "", "1;2|3", "1", "2000"),
    ("b", "f", "presto", "iceberg", "q1", None, None, "2000"),
]


def test_normalise_keeps_valid_rows(spark):
    got = T.normalise(spark.createDataFrame(RAW, trial_csv.RAW_SCHEMA)).orderBy("latency").collect()
    assert [(r.engine_id, r.lake_id, r.latency) for r in got] == [(0, 0, 1500.0), (2, 2, 2000.0)]
    assert got[1].config == [1.0, 2.0, 3.0, 2.0, 2.0]


def test_repair_levels(spark):
    schema = "benchmark string, query_id string, engine_id int, lake_id int, conf string, latency double"
    rows = [("b", "q1", 0, 0, "a", 1500.0), ("b", "q1", 0, 0, "b", 8000.0), ("b", "q2", 0, 0, "c", 1500.0), ("b", "q3", 1, 1, "d", 1500.0)]
    df = spark.createDataFrame(rows, schema)
    moments = {r.query_id: r for r in T.log_moments(df).collect()}
    assert math.isclose(moments["q1"].mu, math.log(8001)) and moments["q1"].sigma == 0.1
    assert math.isclose(moments["q2"].mu, math.log(8001)) and moments["q2"].sigma == 0.1
    assert math.isclose(moments["q3"].mu, math.log(10000)) and moments["q3"].sigma == 0.5
    fixed = T.repair(df)
    assert fixed.where("latency = 1500").count() == 0 and fixed.where("latency < 1501").count() == 0
    assert fixed.where("NOT repaired AND latency <> 8000").count() == 0
    again = T.repair(df.repartition(5, "conf"))
    assert sorted(map(str, fixed.collect())) == sorted(map(str, again.collect()))
    train = T.repair(df, stats_rows=df.where("query_id = 'q1'"))
    assert train.where("latency = 1500").count() == 0


def test_csv_layout(spark, tmp_path):
    raw = spark.createDataFrame([("ssb_flat", "f", "spark", "delta", "q1", "1|2", s, "2000") for s in ("1", "10", "10")], trial_csv.RAW_SCHEMA)
    root = trial_csv.write_trials(raw, ["ssb_flat"])
    assert trial_csv.benchmark_dir(spark, root, "ssb_flat").endswith("ssb-flat")
    assert trial_csv.read_trials(spark, root, "ssb_flat").count() == 3
    assert trial_csv.read_trials(spark, root, "absent").count() == 0
    (tmp_path / "my_bench" / "sf1").mkdir(parents=True)
    (tmp_path / "my_bench" / "sf1" / "a.csv").write_text("engine,datalake,query name,conf,sf,latency\nspark,delta,q1,1|2,1,2000\n")
    (tmp_path / "my_bench" / "b.csv").write_text("latency,sf,conf,query name,datalake,engine\n3000,1,3|4,q2,hudi,trino\n")
    (tmp_path / "my_bench_supply").mkdir()
    (tmp_path / "my_bench_supply" / "c.csv").write_text("engine,datalake,query name,conf,sf,latency\npresto,delta,q3,1|2,1,2500\n")
    mixed = trial_csv.read_trials(spark, str(tmp_path), "my_bench")
    got = sorted((r.engine, r.query_name, r.latency, r.file_name) for r in mixed.collect())
    assert got == [("spark", "q1", "2000", "a.csv"), ("trino", "q2", "3000", "b.csv")]
    supply = trial_csv.read_trials(spark, str(tmp_path), "my_bench", supply=True)
    assert [r.query_name for r in supply.collect()] == ["q3"]


def test_split_shares(spark):
    queries = spark.range(90).select(F.lit("b").alias("benchmark"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id"))
    counts = {r.split: r["count"] for r in T.split_queries(queries).groupBy("split").count().collect()}
    assert counts == {"train": int(90 * 0.7), "valid": int(90 * 0.15), "test": 90 - int(90 * 0.7) - int(90 * 0.15)}


def test_sampled_workloads(spark, folder):
    trials = T.normalise(trials_raw(spark, folder))
    stats = W.combo_stats(trials)
    members = W.sample_workloads(T.query_ids(trials), stats, 40, seed=5)
    rows = members.collect()
    by_workload = {}
    for r in rows:
        by_workload.setdefault(r.workload_id, []).append(r)
    assert len(by_workload) == 40
    combos = {}
    for r in stats.collect():
        combos.setdefault((r.benchmark, r.query_id), set()).add((r.engine_id, r.lake_id))
    for group in by_workload.values():
        names = [(r.benchmark, r.query_id) for r in group]
        assert 3 <= len(names) == len(set(names)) <= 15
        common = set.intersection(*[combos[n] for n in names])
        assert len(common) >= 3
        assert {(b // 3, b % 3) for b in range(9) if group[0].mask >> b & 1} == common


def test_few_queries_bound_the_size(spark):
    stats = spark.createDataFrame([("b", f"q{q}", e, 0, 1.0) for q in range(2) for e in range(3)], "benchmark string, query_id string, engine_id int, lake_id int, best_lat double")
    members = W.sample_workloads(stats.select("benchmark", "query_id").distinct(), stats, 3)
    assert members.groupBy("workload_id").count().where("count <> 2").count() == 0
    empty = W.sample_workloads(stats.select("benchmark", "query_id").limit(0), stats, 3)
    assert empty.count() == 0


@pytest.mark.parametrize("n", [1, 16, 17, 40, 100])
def test_quantile_sample_positions(spark, n):
    # Every latency occurs twice, so copies matter.
    lats = [float(2000 + i // 2) for i in range(n)]
    df = spark.createDataFrame([("b", "q", 0, 0, "1|2", x) for x in lats], "benchmark string, query_id string, engine_id int, lake_id int, conf string, latency double")
    got = sorted(x for r in W.quantile_sample(df).collect() for x in [r.latency] * r.copies)
    if n <= 16:
        expected = sorted(lats)
    else:
        step = max(1, n // 15)
        spots = {0, n - 1} | {min(i * step, n - 1) for i in range(1, 15)}
        expected = [lats[i] for i in sorted(spots)]
    assert got == expected


def test_csv_files_of_different_widths(spark, tmp_path):
    folder = tmp_path / "b" / "sf1"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("engine,datalake,query name,conf,sf,latency\nspark,,q1,1|2,1,2000\nspark,delta,q2,1|2,1,\n")
    (folder / "b.csv").write_text("x,y,engine,datalake,query name,conf,sf,latency\n1,,presto,hudi,q3,3;4,1,3000\n,,,,q4,,1,4000\n")
    got = {(r.query_name, r.engine, r.latency) for r in trial_csv.read_trials(spark, str(tmp_path), "b").collect()}
    assert got == {("q1", "spark", "2000"), ("q2", "spark", None), ("q3", "presto", "3000"), ("q4", None, "4000")}
    pooled = trial_csv.read_pooled(spark, str(tmp_path), ["b", "absent"], use_supply=True)
    assert pooled.count() == 4
