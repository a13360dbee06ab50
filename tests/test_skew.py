"""Ranking, running values and lookups on one hot group."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakewright.operators.ranks import not_in, with_rank
from lakewright.operators.skew import estimated_bytes, hot_keys, lookup, salted_join, split_scan, task_count
from lakewright.operators.trees import forest_offsets
from lakewright.sources.tables import spread


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    hot = [("hot", rng.randrange(50), rng.randrange(1, 5)) for _ in range(800)]
    cold = [(f"g{rng.randrange(20)}", rng.randrange(50), rng.randrange(1, 5)) for _ in range(400)]
    return hot + cold


def test_prefix_sum_matches_brute_force(spark, rows):
    merged = {}
    for g, o, w in rows:
        merged[g, o] = merged.get((g, o), 0) + w
    df = spark.createDataFrame([(g, o, w) for (g, o), w in merged.items()], "g string, o int, w long")
    got = split_scan(df, ["g"], ["o"], F.col("w"), out="start", total="n").collect()
    assert len(got) == len(merged)
    for r in got:
        assert r.start == sum(w for (g, o), w in merged.items() if g == r.g and o < r.o)
        assert r.n == sum(w for (g, _), w in merged.items() if g == r.g)


def test_hot_group_spreads_over_slabs(spark):
    df = spark.range(4000).select(F.lit("hot").alias("g"), F.col("id").alias("o"))
    parts = df.repartitionByRange(8, "g", "o").select(F.spark_partition_id().alias("p"))
    assert parts.distinct().count() > 4
    ranked = split_scan(df, ["g"], ["o"], out="rank")
    assert ranked.where("rank <> o").count() == 0


def test_prefix_minimum(spark, rows):
    values = [(g, i, o) for i, (g, o, _) in enumerate(rows)]
    df = spark.createDataFrame(values, "g string, i int, v int")
    got = split_scan(df, ["g"], ["i"], F.struct("v", "i"), how="min", out="best").collect()
    assert len(got) == len(values)
    for r in got:
        assert tuple(r.best) == min((v, i) for g, i, v in values if g == r.g and i <= r.i)


def test_scan_without_group(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "x int")
    assert {r.x: r.pos for r in split_scan(df, [], ["x"], out="pos").collect()} == {1: 0, 3: 1, 5: 2, 9: 3}


def test_broadcast_and_salted_lookup_agree(spark, rows):
    big = spark.createDataFrame(rows, "g string, o int, w int").repartition(8)
    small = big.groupBy("g").agg(F.max("o").alias("top")).where("g <> 'g3'")
    for how in ("left", "inner"):
        near = sorted(map(str, lookup(big, small, ["g"], how).collect()))
        far = sorted(map(str, lookup(big, small, ["g"], how, limit_bytes=0).collect()))
        assert near == far
    assert salted_join(big, small, ["g"], "left").count() == len(rows)


@pytest.mark.parametrize("kind", ["rank", "dense_rank", "percent_rank"])
def test_ranks_match_window(spark, rows, kind):
    from pyspark.sql import Window

    df = spark.createDataFrame(rows, "g string, o int, w int")
    window = Window.partitionBy("g").orderBy(F.desc("o"))
    expected = df.withColumn("r", getattr(F, kind)().over(window))
    got = with_rank(df, ["g"], "o", kind, "r")
    order = ["g", "o", "w", "r"]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(map(tuple, expected.select(order).collect()))


def test_not_in_null_rules(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    plain = spark.createDataFrame([(2,)], "v int")
    with_null = spark.createDataFrame([(2,), (None,)], "v int")
    empty = spark.createDataFrame([], "v int")
    assert [r.k for r in not_in(left, "k", plain, "v").collect()] == [1]
    assert not_in(left, "k", with_null, "v").count() == 0
    assert not_in(left, "k", empty, "v").count() == 3


def test_release_deletes_written_tables(spark):
    from pathlib import Path

    from lakewright import session

    kept, session._written[:] = session._written[:], []
    try:
        df = session.materialize(spark.range(10))
        path = Path(session._written[0])
        assert df.count() == 10 and path.exists()
        assert session.release(spark) == 1
        assert not path.exists()
    finally:
        session._written[:] = kept


@pytest.mark.parametrize("kind", ["rank", "dense_rank", "percent_rank"])
@pytest.mark.parametrize("descending", [True, False])
def test_ranks_keep_nulls(spark, kind, descending):
    data = [("a", 1.0), ("a", None), ("a", 1.0), ("a", 3.0), (None, 2.0), (None, None), (None, 5.0), ("b", None)]
    df = spark.createDataFrame(data, "g string, o double")
    order = F.desc("o") if descending else F.asc("o")
    window = Window.partitionBy("g").orderBy(order)
    expected = df.withColumn("r", getattr(F, kind)().over(window))
    got = with_rank(df, ["g"], "o", kind, "r", descending)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_split_scan_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), (None, 3)], "g string, o int")
    got = split_scan(df, ["g"], ["o"], out="start", total="n").collect()
    assert sorted((r.g or "", r.o, r.start, r.n) for r in got) == [("", 1, 0, 3), ("", 2, 1, 3), ("", 3, 2, 3), ("a", 1, 0, 1)]


def test_size_of_a_join_is_not_the_product_of_its_sides(spark, tmp_path):
    """A frame joined to an aggregate of its own is about as large as before, and gets as many tasks."""
    spark.range(200000).selectExpr("id", "id % 5000 AS k", "md5(cast(id AS string)) AS t").write.parquet(f"{tmp_path}/big")
    big = spark.read.parquet(f"{tmp_path}/big")
    big.groupBy("k").agg(F.max("t").alias("m")).write.parquet(f"{tmp_path}/small")
    small = spark.read.parquet(f"{tmp_path}/small")
    joined = big.join(F.broadcast(small), "k")
    assert estimated_bytes(joined) <= 4 * (estimated_bytes(big) + estimated_bytes(small))
    assert task_count(joined) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A file may have as many splits as there are cores and all its rows in one of them."""
    spark.range(200000).selectExpr("id", "md5(cast(id AS string)) AS t").coalesce(1).write.parquet(f"{tmp_path}/one")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        scan = spark.read.parquet(f"{tmp_path}/one")
        cores = spark.sparkContext.defaultParallelism
        assert scan.rdd.getNumPartitions() >= cores
        rows = spread(scan, "id")
        split = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in split) == 200000
        assert max(r["count"] for r in split) * cores <= 2 * 200000
        assert rows.exceptAll(scan).isEmpty() and scan.exceptAll(rows).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_forest_offsets_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def size(n):
        seen.add(1)
        return n

    rows = spark.range(100).select(F.format_string("p%03d", "id").alias("plan_key"), size("id").alias("n_nodes"))
    got = {r.plan_key: r.node_offset for r in forest_offsets(rows).collect()}
    assert got == {f"p{i:03d}": i * (i - 1) // 2 for i in range(100)}
    assert seen.value == 100


def test_a_side_as_large_as_the_other_is_repeated_for_hot_keys_only(spark, tmp_path):
    key = F.expr("CASE WHEN id < 3000 THEN -1 WHEN id % 100 = 0 THEN NULL ELSE id END")
    spark.range(20000).select(key.alias("k"), F.col("id").alias("v")).write.parquet(f"{tmp_path}/big")
    big = spark.read.parquet(f"{tmp_path}/big")
    big.groupBy("k").agg(F.count("*").alias("n")).write.parquet(f"{tmp_path}/small")
    small = spark.read.parquet(f"{tmp_path}/small")
    assert [r.k for r in hot_keys(big, ["k"]).collect()] == [-1]
    for how in ("left", "inner"):
        got = salted_join(big, small, ["k"], how)
        assert got.columns == ["k", "v", "n"]
        assert got.exceptAll(big.join(small, ["k"], how)).isEmpty()
        assert got.count() == big.join(small, ["k"], how).count()
    plan = salted_join(big, small, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_hot") > 0
