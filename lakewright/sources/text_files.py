"""Whole text files: plan captures, histograms; and line-wise training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file_name, text), one row per file."""
    return (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, line) of all ``train_*.log`` files."""
    return (
        spark.read.option("pathGlobFilter", "train_*.log")
        .option("recursiveFileLookup", True)
        .text(path)
        .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line"))
    )


def capture_plan(df: DataFrame) -> str:
    """Text of a live DataFrame's optimized and physical plan, in the captured layout, whole lists included."""
    conf, setting = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(setting, None)
    conf.set(setting, str((1 << 31) - 1))
    try:
        execution = df._jdf.queryExecution()
        optimized = execution.optimizedPlan().toString().rstrip("\n")
        physical = execution.executedPlan().toString()
    finally:
        conf.unset(setting) if before is None else conf.set(setting, before)
    return f"== Optimized Logical Plan ==\n{optimized}\n\n== Physical Plan ==\n{physical}\n"


def plan_table(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """(file_name, text) of live plans, keyed ``{name}_plan.txt``."""
    rows = [(f"{name}_plan.txt", capture_plan(df)) for name, df in frames.items()]
    return spark.createDataFrame(rows, "file_name string, text string")
