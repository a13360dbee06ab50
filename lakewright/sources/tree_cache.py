"""Parquet cache of plan trees, partitioned by benchmark and keyed by what they were built from.

A tree's key is a hash of its plan text and of the settings of the build. A run computes the trees whose key
is not in the cache, and rewrites only the benchmarks in which a tree is new or no longer asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.session import materialize, scratch_path


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def content_key(text: str, settings: str):
    """Hash of a plan text and the settings its tree is built with."""
    return F.sha2(F.concat(F.lit(settings), F.lit("\0"), F.coalesce(text, F.lit(""))), 256)


def load_trees(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame | None:
    """Cached trees, or those of ``wanted`` (benchmark, plan_key, content); None without a cache."""
    if not _exists(spark, root):
        return None
    trees = spark.read.parquet(root)
    return trees if wanted is None else trees.join(wanted, ["benchmark", "plan_key", "content"], "left_semi")


def cached_trees(
    files: DataFrame, root: str, build: Callable[[DataFrame], DataFrame], settings: str, run: str = ""
) -> DataFrame:
    """Trees of ``files`` (benchmark, plan_key, text and other columns), from the cache or built.

    ``build`` gets the files whose trees are missing and returns rows with benchmark and plan_key, any number
    per plan. Built rows carry ``content`` and ``run``. Of several texts with one plan_key each has its own
    trees. The cache keeps the trees of ``files`` only: benchmarks without files lose theirs.
    """
    spark = files.sparkSession
    keyed = files.withColumn("content", content_key("text", settings))
    wanted = materialize(keyed.select("benchmark", "plan_key", "content").distinct())
    have = load_trees(spark, root)
    if have is None:
        missing, stale, kept = wanted, wanted.limit(0), None
    else:
        held = have.select("benchmark", "plan_key", "content").distinct()
        on = ["benchmark", "plan_key", "content"]
        # One join for both differences.
        both = wanted.withColumn("_w", F.lit(True)).join(held.withColumn("_h", F.lit(True)), on, "full")
        both = materialize(both.where("_w IS NULL OR _h IS NULL"))
        missing, stale = both.where("_h IS NULL").select(*on), both.where("_w IS NULL").select(*on)
        kept = have.join(stale, on, "left_anti")  # a cached tree that is not stale is asked for
    changed = missing.select("benchmark").union(stale.select("benchmark")).distinct()
    touched = [r.benchmark for r in changed.collect()]  # a row per benchmark
    if not touched and have is not None:
        return have
    # Without a cache every text is missing; those without a key find no row of ``missing`` below.
    todo = keyed if have is None else keyed.join(missing, ["benchmark", "plan_key", "content"], "left_semi")
    built = build(todo.drop("content")).join(missing, ["benchmark", "plan_key"]).withColumn("run", F.lit(run))
    if kept is not None:
        built = built.unionByName(kept.where(F.col("benchmark").isin(touched)))
    if have is None:
        built.write.partitionBy("benchmark").parquet(root)
        return spark.read.schema(built.schema).parquet(root)
    # Written aside first: the rows come from the folders that are about to be replaced.
    aside = scratch_path(spark, "trees")
    built.write.partitionBy("benchmark").parquet(aside)
    rows = spark.read.schema(built.schema).parquet(aside)
    left = {r.benchmark for r in rows.select("benchmark").distinct().collect()}  # a row per benchmark
    _replace(spark, aside, root, [f"benchmark={b}" for b in touched if b not in left])
    return spark.read.schema(built.schema).parquet(root)


def _replace(spark: SparkSession, aside: str, root: str, emptied: list[str]) -> None:
    """Put the folders of ``aside`` in the place of those of their name; the emptied ones go."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in emptied:
        fs.delete(path(f"{root}/{name}"), True)
    for folder in [s.getPath() for s in fs.listStatus(path(aside)) if s.isDirectory()]:
        target = path(path(root), folder.getName())
        fs.delete(target, True)
        if not fs.rename(folder, target):
            raise OSError(f"{folder} could not replace {target}")
