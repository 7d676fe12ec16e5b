"""Session settings that the library's results rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: UTC keeps timestamps equal on every engine; AQE splits skewed joins and merges small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "parlance", master: str | None = None, **settings: str) -> SparkSession:
    """The active session, or a new one with SETTINGS and then `settings` (dots written as __)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints (spark.checkpoint.dir).

    Where none is set: a temporary one under a local master, as in tests; elsewhere one in the warehouse, which a
    cluster shares as well. A cluster whose warehouse is on the driver's disk has to set spark.checkpoint.dir, or it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        local = re.fullmatch(r"local(\[[^\[\]]*\])?", context.master) is not None
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not local and re.match("file:|/", warehouse):
            raise ValueError("no folder that the cluster shares: set spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-") if local else f"{warehouse}/_checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in a new folder of the shared folder, for a table; what is left there goes when the driver ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path, files = _hadoop(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/rows"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """`rows`, written to a scratch() table, so that several readers don't each make them."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def remove(spark: SparkSession, table_path: str) -> None:
    """Deletes what scratch() gave."""
    path, files = _hadoop(spark, table_path)
    files.delete(path.getParent(), True)


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())
