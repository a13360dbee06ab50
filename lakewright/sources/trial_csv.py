"""Trial CSV files: ``{root}/{benchmark}/sf{N}/*.csv``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.operators.skew import lookup
from lakewright.session import scratch_path

HEADER = ["engine", "datalake", "query name", "conf", "sf", "latency"]
COLUMNS = ["engine", "datalake", "query_name", "conf", "sf", "latency"]
RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("benchmark", "file_name", *COLUMNS)]
)


def benchmark_dir(spark: SparkSession, root: str, benchmark: str, supply: bool = False) -> str | None:
    """Directory of a benchmark: dashes for underscores first, then the name as it is."""
    name = f"{benchmark}_supply" if supply else benchmark
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for candidate in (name.replace("_", "-"), name):
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{candidate}")
        if path.getFileSystem(conf).exists(path):
            return f"{root}/{candidate}"
    return None


def _csv(spark: SparkSession):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")


def _by_header(spark: SparkSession, folder: str) -> DataFrame:
    header = _csv(spark).option("header", True).csv(folder).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = _csv(spark).schema(schema).option("header", True).option("enforceSchema", False).csv(folder)
    picked = [
        (F.col(f"`{h}`") if h in header else F.lit(None).cast("string")).alias(c)
        for h, c in zip(HEADER, COLUMNS)
    ]
    return rows.select(F.col("_metadata.file_name").alias("file_name"), *picked)


def _by_file_header(spark: SparkSession, folder: str) -> DataFrame:
    lines = _csv(spark).text(folder)
    # No line has more cells than commas and one, so no cell of the widest file is lost.
    commas = F.length("value") - F.length(F.replace("value", F.lit(","), F.lit("")))
    width = (lines.agg(F.max(commas)).first()[0] or 0) + 1
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    wide = _csv(spark).schema(schema).option("header", False).csv(folder)
    rows = wide.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.array(*wide.columns).alias("cells"),
    )
    # An empty cell is null, and a list with a null does not say that a name is missing.
    is_header = F.coalesce(F.array_contains("cells", "query name") & F.array_contains("cells", "latency"), F.lit(False))
    headers = rows.where(is_header).select("file_path", F.col("cells").alias("names"))
    body = lookup(rows.where(~is_header), headers, ["file_path"], "inner")
    picked = [
        F.try_element_at("cells", F.nullif(F.array_position("names", h), F.lit(0)).cast("int")).alias(c)
        for h, c in zip(HEADER, COLUMNS)
    ]
    return body.select("file_name", *picked)


def read_trials(
    spark: SparkSession, root: str, benchmark: str, supply: bool = False, one_header: bool = False
) -> DataFrame:
    """All CSV rows of a benchmark as text; an absent directory gives an empty table.

    Columns are matched by the header of each file. ``one_header`` saves the scan that reads the
    headers where all files share one; a differing one is then an error.
    """
    folder = benchmark_dir(spark, root, benchmark, supply)
    if folder is None:
        return spark.createDataFrame([], RAW_SCHEMA)
    rows = _by_header(spark, folder) if one_header else _by_file_header(spark, folder)
    return rows.select(F.lit(benchmark).alias("benchmark"), "file_name", *COLUMNS)


def read_pooled(spark: SparkSession, root: str, benchmarks: list[str], use_supply: bool = False) -> DataFrame:
    logs = []
    for benchmark in benchmarks:
        logs.append(read_trials(spark, root, benchmark))
        if use_supply:
            logs.append(read_trials(spark, root, benchmark, supply=True))
    pooled, *rest = logs
    for log in rest:
        pooled = pooled.unionByName(log)
    return pooled


def write_trials(raw: DataFrame, benchmarks: list[str]) -> str:
    """Write raw trials in the CSV layout below a fresh shared path and return its root."""
    root = scratch_path(raw.sparkSession, "trials")
    scale = F.when(F.col("sf") == "", "none").otherwise(F.col("sf"))
    columns = [F.col(c).alias(h) for h, c in zip(HEADER, COLUMNS)]
    for benchmark in benchmarks:
        part = raw.where(F.col("benchmark") == benchmark).select(*columns, scale.alias("scale"))
        writer = part.write.option("header", True).option("emptyValue", "").partitionBy("scale")
        writer.csv(f"{root}/{benchmark.replace('_', '-')}")
    return root
