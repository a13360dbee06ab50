"""Queries over training logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.operators import training_logs as G
from lakewright.plans import sqltext as Q
from lakewright.plans.registry import query
from lakewright.session import scratch_path
from lakewright.sources.derived import log_lines
from lakewright.sources.tables import table
from lakewright.sources.text_files import read_logs

_RUNS = r"""logs AS (SELECT *, regexp_extract(file_name, '^train_(.*)\.log$', 1) AS run FROM log_lines WHERE regexp_matches(file_name, '^train_.*\.log$'))"""
_BASE = (Q.LOG_LINES, _RUNS)
_CHART = r"Epoch\s+(\d+):\s+expert=([\d.]+)\s+test_ratio=([\d.]+)\s+best=([\d.]+)@ep(\d+)\s+\(target=([\d.]+)\)"
_EMITTED = r"Epoch\s+(\d+): s1=([\d.]+) \(mse=([\d.]+) ce=([\d.]+) div=([\d.]+)\) s2=([\d.]+) s3=([\d.]+) valid_ratio=([\d.]+)\s+best_valid=([\d.]+)@ep(\d+)"


AT_EPOCH = r"@ep(\d+)"


def logs(spark, folder):
    return G.run_logs(log_lines(spark, folder))


def _fields(pattern, names):
    # DuckDB numbers groups up to nine.
    return ", ".join(
        f"regexp_extract(line, '{pattern if i < 9 else AT_EPOCH}', {i + 1 if i < 9 else 1})::{'int' if n in ('epoch', 'best_epoch') else 'double'} AS {n}" for i, n in enumerate(names)
    )


_CHART_CTE = f"chart AS (SELECT run, {_fields(_CHART, ['epoch', 'loss', 'ratio', 'best', 'best_epoch', 'target'])} FROM logs WHERE regexp_matches(line, '{_CHART}'))"
_EMITTED_CTE = f"emitted AS (SELECT run, {_fields(_EMITTED, ['epoch', 's1', 'mse', 'ce', 'div', 's2', 's3', 'valid_ratio', 'best_valid', 'best_epoch'])} FROM logs WHERE regexp_matches(line, '{_EMITTED}'))"


@query(
    "s8_log_scan",
    Q.with_(*_BASE, select="SELECT run, count(*) AS n_lines, sum(length(line))::bigint AS n_chars FROM logs GROUP BY 1"),
)
def _(spark, folder):
    root = scratch_path(spark, "logs")
    lines = log_lines(spark, folder)
    # One directory per log file, so that many tasks write a large log at once.
    lines.select("file_name", "line").write.partitionBy("file_name").text(root)
    read = spark.read.text(root).select("file_name", F.col("value").alias("line"))
    runs = G.run_logs(read)
    return runs.groupBy("run").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("l1_chart_epochs", Q.with_(*_BASE, _CHART_CTE, select="SELECT * FROM chart"))
def _(spark, folder):
    return G.chart_epochs(logs(spark, folder))


@query("l2_emitted_epochs", Q.with_(*_BASE, _EMITTED_CTE, select="SELECT * FROM emitted"))
def _(spark, folder):
    return G.emitted_epochs(logs(spark, folder))


@query(
    "l3_run_summary",
    Q.with_(
        *_BASE,
        r"""best AS (SELECT run, arg_min(regexp_extract(line, 'ratio: ([0-9.]+)', 1), line_no) AS best_valid FROM logs WHERE contains(line, 'Training complete') GROUP BY 1),
        final AS (SELECT run, arg_min(regexp_extract(line, 'ep[0-9]+\): ([0-9.]+)', 1), line_no) AS final_test FROM logs WHERE contains(line, 'Final test ratio') GROUP BY 1)""",
        select="SELECT run, best_valid, coalesce(final_test, 'N/A') AS final_test FROM best LEFT JOIN final USING (run)",
    ),
)
def _(spark, folder):
    return G.summary(logs(spark, folder))


@query("l4_run_series", Q.with_(*_BASE, _CHART_CTE, select="SELECT run, epoch, loss, ratio, best, target FROM chart"))
def _(spark, folder):
    return G.series(G.chart_epochs(logs(spark, folder)))


_METRICS = "metrics AS (SELECT event_type AS run, event_id AS epoch, value AS ratio FROM events)"


def metrics(spark, folder):
    return table(spark, folder, "events").select(
        F.col("event_type").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("ratio")
    )


@query(
    "w9_best_so_far",
    Q.with_(
        _METRICS,
        "running AS (SELECT *, min((ratio, epoch)) OVER (PARTITION BY run ORDER BY epoch) AS b FROM metrics)",
        select="SELECT run, epoch, ratio, b[1] AS best_ratio, b[2] AS best_epoch FROM running",
    ),
)
def _(spark, folder):
    return G.best_so_far(metrics(spark, folder), ["run"], ["epoch"], "ratio")


@query(
    "m11_model_selection",
    Q.with_(
        _METRICS,
        select="SELECT run, min(ratio) AS best_ratio, arg_min(epoch, (ratio, epoch)) AS best_epoch, count(*) AS n_epochs FROM metrics GROUP BY 1",
    ),
)
def _(spark, folder):
    return G.select_model(metrics(spark, folder), ["run"], ["epoch"], "ratio")
