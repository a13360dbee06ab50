"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.session import materialize


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan whose rows lie in fewer splits than there are cores, rewritten with one split per core.

    For work bound by CPU on tables of few files. A file has a split per so many bytes, but all rows of a row
    group come with one of them, so the rows of the splits are counted. Written out, because filters move
    below a mere repartition and would then run on the few original splits. Only for plain scans: counting
    reads little. ``spark.lakewright.spread`` = false turns it off.
    """
    spark = scan.sparkSession
    if spark.conf.get("spark.lakewright.spread", "true") != "true":
        return scan
    cores = spark.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        split = scan.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n"))
        most, total = split.agg(F.max("n"), F.sum("n")).first()
        if not total or most * cores <= 2 * total:
            return scan
    return materialize(scan.repartition(cores, *keys))
