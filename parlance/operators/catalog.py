"""Event catalogues: pools of the events that a scene may use, and checks of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.quota import hash_order, ranked, uniform


#: Most values of a catalogue's column that one row may list; the row goes to every task.
MOST_LISTED = 100_000


def one_list(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One row whose `name` lists the different values of a short column, in order; more than MOST_LISTED raise."""
    values = F.array_sort(F.collect_set(column))
    return rows.agg(F.count_distinct(column).alias("_n"), values.alias("_v")).select(F.when(F.col("_n") > MOST_LISTED, F.raise_error(F.lit(f"more than {MOST_LISTED} values of {column}"))).otherwise(F.col("_v")).alias(name))


def scene_pool(own: DataFrame, shared: DataFrame, general: DataFrame, scenes: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(scene, event, branch): own events, shared ones, then general ones that the scene doesn't forbid.

    own, shared, forbidden: (scene, event); general: (event); scenes: (scene). General events meet scenes by
    an array of the scenes (a catalogue's scenes are a short list) that is exploded, not by a cross join.
    """
    allowed = allowed_everywhere(general, scenes, forbidden)
    branches = [own.select("scene", "event"), shared.select("scene", "event"), allowed]
    rows = [df.withColumn("branch", F.lit(i)) for i, df in enumerate(branches)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def allowed_everywhere(events: DataFrame, scenes: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(scene, event): events of no scene of their own (general or rare ones) in every scene that doesn't forbid them."""
    listed = one_list(scenes, "scene", "s").withColumn("k", F.lit(1))
    everywhere = events.withColumn("k", F.lit(1)).join(F.broadcast(listed), "k").select(F.explode("s").alias("scene"), "event")
    return everywhere.join(forbidden, ["scene", "event"], "left_anti")


def gaps(pool: DataFrame, scenes: DataFrame, least: int) -> DataFrame:
    """(scene, n): scenes with fewer than `least` distinct events to choose from."""
    counts = pool.groupBy("scene").agg(F.countDistinct("event").alias("n"))
    return scenes.join(counts, "scene", "left").select("scene", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def unknown_references(refs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of `refs` whose key the catalogue doesn't know."""
    return refs.join(known.select(key), key, "left_anti")


def rare_faults(forbidden: DataFrame, rare: DataFrame, scenes: DataFrame) -> DataFrame:
    """(event, scene, fault) of exclusions (event, scene) of rare events that name an unknown event or an unknown scene; none where no rare event is excluded at all."""
    rows = forbidden.join(rare.select("event", F.lit(True).alias("_e")).distinct(), "event", "left").join(scenes.select("scene", F.lit(True).alias("_s")).distinct(), "scene", "left")
    fault = F.when(F.col("_e").isNull(), "unknown event").when(F.col("_s").isNull(), "unknown scene")
    some = forbidden.join(rare, "event", "left_semi").limit(1).select(F.lit(True).alias("_any"))
    return rows.select("event", "scene", fault.alias("fault")).where("fault IS NOT NULL").join(F.broadcast(some), F.lit(True)).drop("_any")  # a row at most


def summary(**tables: DataFrame) -> DataFrame:
    """(bank, n): sizes of the catalogue's tables."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("bank"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def takes(wants: DataFrame, files: DataFrame, key: str, pool: str = "pool", split: str = "split", name: str = "name", salt: str = "take") -> DataFrame:
    """`wants` with `name`: a file of each row's pool, of its own split, drawn by a hash of its key; null where there is none.

    files: (pool, split, name), each pool split by quota.partition_files(). A row without a split draws from its whole pool. The files of a
    pool and split are numbered by their names' hashes, and a row meets the one whose number its own hash gives, so that a pool is
    never gathered, and a pool that many rows want is spread over its files.
    """
    own = files.where(F.col(name).isNotNull()).select(pool, F.coalesce(split, F.lit("")).alias(split), name)
    every = own.where(F.col(split) != "").unionByName(own.select(pool, F.lit("").alias(split), name)).distinct()
    listed = ranked(every.withColumn("_h", hash_order("file", name)), [pool, split], ["_h", name]).select(F.col(pool).alias("_pool"), F.col(split).alias("_split"), F.col("rank").alias("_rank"), F.col("n").alias("_size"), name)
    sizes = listed.groupBy("_pool", "_split").agg(F.max("_size").alias("_n"))
    rows = wants.withColumn("_want", F.coalesce(split, F.lit("")))
    rows = rows.join(sizes, (F.col(pool) == F.col("_pool")) & (F.col("_want") == F.col("_split")), "left").drop("_pool", "_split")
    rows = rows.withColumn("_at", F.floor(uniform(salt, key) * F.col("_n")).cast("long")).drop("_n")
    return rows.join(listed.drop("_size"), (F.col(pool) == F.col("_pool")) & (F.col("_want") == F.col("_split")) & (F.col("_at") == F.col("_rank")), "left").drop("_pool", "_split", "_want", "_at", "_rank")
