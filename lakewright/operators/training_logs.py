"""Training logs: epoch lines, summaries and the best epoch so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.skew import split_scan

# The two line formats and the closing lines.
CHART = r"Epoch\s+(\d+):\s+expert=([\d.]+)\s+test_ratio=([\d.]+)\s+best=([\d.]+)@ep(\d+)\s+\(target=([\d.]+)\)"
EMITTED = (
    r"Epoch\s+(\d+): s1=([\d.]+) \(mse=([\d.]+) ce=([\d.]+) div=([\d.]+)\) s2=([\d.]+) s3=([\d.]+) "
    r"valid_ratio=([\d.]+)\s+best_valid=([\d.]+)@ep(\d+)"
)
BEST = r"Training complete.*?ratio: ([0-9.]+)"
FINAL = r"Final test ratio.*?ep[0-9]+\): ([0-9.]+)"


def run_logs(lines: DataFrame) -> DataFrame:
    """Lines of ``train_*.log`` files, with the run named after the file."""
    kept = lines.where(F.col("file_name").rlike(r"^train_.*\.log$"))
    return kept.withColumn("run", F.regexp_extract("file_name", r"^train_(.*)\.log$", 1))


def _parse(lines: DataFrame, pattern: str, names: list[tuple[str, str]]) -> DataFrame:
    fields = [F.regexp_extract("line", pattern, i + 1).cast(kind).alias(name) for i, (name, kind) in enumerate(names)]
    return lines.where(F.col("line").rlike(pattern)).select("run", *fields)


def chart_epochs(lines: DataFrame) -> DataFrame:
    names = [("epoch", "int"), ("loss", "double"), ("ratio", "double"), ("best", "double"), ("best_epoch", "int"), ("target", "double")]
    return _parse(lines, CHART, names)


def emitted_epochs(lines: DataFrame) -> DataFrame:
    names = [("epoch", "int")] + [(n, "double") for n in ("s1", "mse", "ce", "div", "s2", "s3", "valid_ratio", "best_valid")]
    return _parse(lines, EMITTED, [*names, ("best_epoch", "int")])


def _first_match(pattern: str) -> Column:
    value = F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1))
    return F.min(F.when(value.isNotNull(), F.struct(F.col("line_no"), value.alias("v"))))["v"]


def summary(lines: DataFrame) -> DataFrame:
    """Best validation and final test ratio per run; runs without a result are left out."""
    found = lines.groupBy("run").agg(_first_match(BEST).alias("best_valid"), _first_match(FINAL).alias("final_test"))
    return found.where("best_valid IS NOT NULL").select("run", "best_valid", F.coalesce("final_test", F.lit("N/A")).alias("final_test"))


def series(epochs: DataFrame) -> DataFrame:
    """Rows behind the curves: loss, ratio and logged best per epoch, of runs with any epoch."""
    return epochs.select("run", "epoch", "loss", "ratio", "best", "target")


def best_so_far(metrics: DataFrame, group: list[str], order: list[str], ratio: str) -> DataFrame:
    """Lowest ratio up to each row and where it was first reached."""
    value = F.struct(F.col(ratio).alias("ratio"), *order)
    ranked = split_scan(metrics, group, order, value, how="min", out="_best")
    return ranked.select(
        *metrics.columns,
        F.col("_best.ratio").alias("best_ratio"),
        *[F.col(f"_best.{c}").alias(f"best_{c}") for c in order],
    )


def select_model(metrics: DataFrame, group: list[str], order: list[str], ratio: str) -> DataFrame:
    """Per group: the row with the lowest ratio, the earliest on ties."""
    best = F.min(F.struct(F.col(ratio).alias("ratio"), *order))
    return metrics.groupBy(*group).agg(best.alias("b"), F.count("*").alias("n_epochs")).select(
        *group, F.col("b.ratio").alias("best_ratio"), *[F.col(f"b.{c}").alias(f"best_{c}") for c in order], "n_epochs"
    )
