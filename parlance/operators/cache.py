"""Caches of model replies as keyed tables: union, completeness, resumption."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(sources: list[DataFrame], key: str, is_error: str) -> DataFrame:
    """One row per key. An answer goes before an error; among equals, the earlier source.

    A pre-aggregated minimum, so a key with many rows is no group in one task.
    """
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, ranked)
    best = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(is_error, "source_rank")).alias("r"))
    return best.select(key, "r.*")


def completeness(items: DataFrame, cache: DataFrame, key: str, compared: list[str], is_error: str) -> DataFrame:
    """(key, finding): missing, intruder, divergent or error; ok otherwise."""
    left = items.select(key, F.lit(True).alias("_i"), *[F.col(c).alias(f"_{c}") for c in compared])
    rows = left.join(cache.withColumn("_c", F.lit(True)), key, "full_outer")
    differ = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in compared], F.lit(False))
    finding = F.when(F.col("_c").isNull(), "missing").when(F.col("_i").isNull(), "intruder").when(differ, "divergent").when(F.col(is_error), "error").otherwise("ok")
    return rows.select(key, finding.alias("finding"))


def run_settings(cache: DataFrame, run: str) -> DataFrame:
    """Distinct settings of the runs that filled a cache; more than one is a finding."""
    return cache.groupBy(run).agg(F.count("*").alias("n"))


def task_verdicts(items: DataFrame, caches: DataFrame, task: str, key: str, compared: list[str], is_error: str, run: str, tolerate_errors: bool = False) -> DataFrame:
    """Per task of `items`: items, cached, missing, intruders, divergent, errors, settings, and verdict: ok, refused, or no cache.

    caches: (task, key, compared, is_error, run), `run` a map or struct of a run's settings, or null. A task is refused for any finding, where two rows
    were made under different settings, and for errors unless they are tolerated.
    """
    keyed = lambda df: df.withColumn("_id", F.struct(task, key))
    found = completeness(keyed(items).drop(task, key), keyed(caches).drop(task, key), "_id", compared, is_error)
    counts = found.groupBy(F.col("_id")[task].alias(task)).agg(*[F.count_if(F.col("finding") == f).alias(name) for f, name in (("missing", "n_missing"), ("intruder", "n_intruders"), ("divergent", "n_divergent"))])
    wanted = items.groupBy(task).agg(F.count("*").alias("n_items"))
    settings = F.when(F.col(run).isNotNull(), F.to_json(run))
    held = caches.groupBy(task).agg(F.count("*").alias("n_cached"), F.count_if(is_error).alias("n_errors"), F.count_distinct(settings).alias("n_settings"))
    rows = wanted.join(held, task, "left").join(counts, task)
    wrong = (F.col("n_missing") + F.col("n_intruders") + F.col("n_divergent") > 0) | (F.col("n_settings") > 1) | (F.lit(not tolerate_errors) & (F.col("n_errors") > 0))
    verdict = F.when(F.col("n_cached").isNull(), "no cache").when(wrong, "refused").otherwise("ok")
    return rows.withColumn("verdict", verdict).fillna(0, ["n_cached", "n_errors", "n_settings"])


def reparsed(cache: DataFrame, fresh: str, stored: str, is_error: str) -> DataFrame:
    """`cache` with `stored` replaced by `fresh` where they differ, and changed; errors are left alone."""
    differ = ~F.col(is_error) & ~F.col(fresh).eqNullSafe(F.col(stored))
    return cache.withColumn("changed", differ).withColumn(stored, F.when(differ, F.col(fresh)).otherwise(F.col(stored)))
