"""A durable store of rows by key: what a resumable stage has finished so far.

Rows are appended in versions, folders numbered from 1, each sorted by a hash of the key; the last version that names a key
counts. A version is there once Spark's committer has marked it whole, so a write that is killed leaves the state as
it was, and its folder is skipped. Dropping writes marks in place of rows. Compaction writes all that counts as one version,
from which reading then starts, and removes the versions before it. One writer at a time.

Defined results: rows without a key are not stored, and items without one are always pending. Of rows with one key in one
version, the greatest counts, column by column. Columns that a version lacks are null. An empty store has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, DROPPED, WHOLE = "rows", "dropped", "whole"


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        if key not in self.schema.names:
            raise ValueError(f"no column {key!r} in {schema!r}")

    def _files(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, whole_only: bool = True) -> list[tuple[int, str]]:
        """(number, kind) of the versions; only committed ones unless told otherwise."""
        path, files = self._files(self.path)
        if not files.exists(path):
            return []
        out = []
        for status in files.listStatus(path):
            number, _, kind = status.getPath().getName().partition("-")
            if number.isdigit() and kind in (ROWS, DROPPED, WHOLE) and (not whole_only or files.exists(self._files(f"{status.getPath()}/_SUCCESS")[0])):
                out.append((int(number), kind))
        return sorted(out)

    def _folder(self, number: int, kind: str) -> str:
        return f"{self.path}/{number:012d}-{kind}"

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str) -> int:
        number = max([n for n, _ in self.versions(whole_only=False)], default=0) + 1
        rows = rows.withColumn("_bucket", self._bucket(F.col(self.key))).withColumn("_version", F.lit(number).cast("long"))
        rows.repartition("_bucket").sortWithinPartitions("_bucket").write.parquet(self._folder(number, kind))
        return number

    def record(self, rows: DataFrame) -> int:
        """Appends rows; gives the version's number."""
        own = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        others = [n for n in self.schema.names if n != self.key]
        own = own.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(*others)).alias("r"))
        return self._write(own.select(self.key, "r.*").withColumn("_gone", F.lit(False)), ROWS)

    def rows(self, only: list | None = None) -> DataFrame:
        """What is stored now; with `only`, of these keys: files and row groups without their buckets are skipped."""
        found = self.versions()
        start = max([n for n, kind in found if kind == WHOLE], default=0)
        paths = [self._folder(n, kind) for n, kind in found if n >= start]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        kept = self.spark.read.schema(", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema), "_gone boolean", "_version long", "_bucket int"])).parquet(*paths)
        if only is not None:
            keys = self.spark.createDataFrame([(k,) for k in only], f"k {self.schema[self.key].dataType.simpleString()}")
            wanted = sorted({r[0] for r in keys.select(self._bucket(F.col("k"))).collect()})
            kept = kept.where(F.col("_bucket").isin(wanted) & F.col(self.key).isin(list(only)))
        others = [n for n in self.schema.names if n != self.key]
        last = kept.groupBy(self.key).agg(F.max_by(F.struct(*others, "_gone"), "_version").alias("r"))
        return last.where("NOT r._gone").select(*[self.key if n == self.key else f"r.{n}" for n in self.schema.names])

    def drop(self, valid: Column) -> int:
        """Forgets the rows that are not valid (null isn't); gives their number."""
        gone = self.rows().where(~F.coalesce(valid, F.lit(False))).select(self.key, *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != self.key], F.lit(True).alias("_gone"))
        before = self.rows().count()
        self._write(gone, DROPPED)
        return before - self.rows().count()

    def pending(self, items: DataFrame, valid: Column | None = None) -> DataFrame:
        """`items` for which nothing is stored, or nothing valid."""
        done = self.rows()
        if valid is not None:
            done = done.where(F.coalesce(valid, F.lit(False)))
        return items.join(done.select(F.col(self.key).alias("_key")), F.col(self.key) == F.col("_key"), "left_anti")

    def compact(self) -> int:
        """Writes all that counts as one version and removes the folders before it, killed writes' too; gives its number."""
        number = self._write(self.rows().withColumn("_gone", F.lit(False)), WHOLE)
        for n, kind in self.versions(whole_only=False):
            if n < number:
                path, files = self._files(self._folder(n, kind))
                files.delete(path, True)
        return number
