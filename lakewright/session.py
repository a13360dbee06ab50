"""Session construction, the shared folder, and the one place that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_releases = 0


def build_session(app: str = "lakewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the configured checkpoint folder.

    Only a local-mode session may fall back to a temporary folder of its own machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="lakewright-")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables written and read back by one job."""
    path = os.path.join(shared_dir(spark), f"lakewright-{name}-{uuid.uuid4()}")
    _written.append(path)
    return path


def written_by(spark: SparkSession) -> tuple[str, int]:
    """What frames on written tables may be remembered under: the application and the number of releases so far."""
    return spark.sparkContext.applicationId, _releases


def release(spark: SparkSession) -> int:
    """Delete the tables this process wrote to the shared folder; frames built on them end here."""
    global _releases
    _releases += 1
    conf = spark._jsc.hadoopConfiguration()
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and continue from that table.

    Several consumers then read what they need of it, column by column, a lost executor costs a
    re-read only, and the planner knows the size of the table.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
