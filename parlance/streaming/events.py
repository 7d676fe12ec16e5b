"""Event-time queries on streams: windows, sessions, deduplication and resumption."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import scratch


def stream(spark: SparkSession, folder: str, name: str = "events", time: str = "ts") -> DataFrame:
    """The files of a table as a stream; its time without zone becomes a timestamp, as watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{folder}/{name}*.parquet")
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(rows: DataFrame, width: str, late: str | None = None, time: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, start, n, total): counts and sums of `value` per window."""
    rows = rows.withWatermark(time, late) if late else rows
    counts = rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(*by, F.col("w.start").alias("start"), "n", "total")


def sessions(rows: DataFrame, gap: str, key: str, late: str | None = None, time: str = "ts") -> DataFrame:
    """(key, start, end, n) of sessions that a pause of `gap` ends."""
    rows = rows.withWatermark(time, late) if late else rows
    found = rows.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def once(rows: DataFrame, keys: list[str], late: str, time: str = "ts") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_to_end(result: DataFrame, mode: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """The result table of a streaming query over all that is there now, from files in the shared folder.

    With the `folder` of an earlier run, the stream goes on where that one stopped. Every batch is written by the executors. In complete mode the last batch is the result, in update mode the last row
    of each of `keys`; nothing passes through the driver. A batch done again after a failure replaces its files.
    """
    spark = result.sparkSession
    folder = folder or scratch(spark, "stream")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    result.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    if mode == "complete":
        return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


def resume(rows: DataFrame, checkpoint: str, path: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Work on what came since the last call and append it to `path`; batches are written once."""

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
