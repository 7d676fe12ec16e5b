"""One long ordered list packed into batches of at most so many items and bytes, as a service takes them.

A batch ends where its next item would be one too many or too large, so where one starts depends on all before. The list is cut into
segments that are sure to hold the end of a batch. Within a segment, a batch that starts at some item leads to a last batch still open at the
segment's end, whatever came before; so each segment maps the starts of the batches that may reach it to the starts of those
that leave it, all segments side by side. These maps are composed by doubling, the few that lie on the way from the first item are
kept, and every segment numbers its items. No task holds more than a segment, and nothing is a group per key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.quota import value_ranges
from parlance.session import scratch

#: Items and bytes of a batch, and the share of the bytes that is used.
MOST_ITEMS, MOST_BYTES, BYTES_MARGIN = 100_000, 256 * 1024 * 1024, 0.9
#: Batches' worth of items and bytes in a segment at least; either makes up at least half of what is over 2, more than a batch.
SPACING = 5
#: Items that a segment of small batches has room for: a group costs a task some milliseconds, however few items it has.
SEGMENT_ITEMS = 50_000


class Segment:
    """Items of a segment, by their place and the bytes before them."""

    def __init__(self, rows: pd.DataFrame, most: int, budget: int):
        rows = rows.sort_values("pos")
        self.first, self.n = int(rows["pos"].iloc[0]), len(rows)
        self.before = np.append(rows["before"].to_numpy(np.int64), rows["before"].iloc[-1] + rows["size"].iloc[-1])
        self.most, self.budget = most, budget
        at = np.arange(self.n)
        self.next = self.end(at + self.first, self.before[:-1])

    def end(self, pos: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The item here that no longer fits a batch that starts at `pos` with `before` bytes before it; n if all do."""
        room = np.searchsorted(self.before, before + self.budget, "right") - 1
        return np.minimum(np.minimum(pos + self.most - self.first, room), self.n).astype(np.int64)

    def exits(self) -> tuple[np.ndarray, np.ndarray]:
        """For a batch started at each item: the start of the last batch here, and how many more start."""
        at = np.arange(self.n)
        last = np.where(self.next < self.n, self.next, at)
        jumps = (self.next < self.n).astype(np.int64)
        while True:
            further = jumps + jumps[last]
            if (further == jumps).all():
                return last, jumps
            jumps, last = further, last[last]

    def starts(self, first: int) -> np.ndarray:
        """Whether a batch starts at each item, given the first that does."""
        out = np.zeros(self.n, bool)
        while first < self.n:
            out[first] = True
            first = int(self.next[first])
        return out


def placed(items: DataFrame, order: list[str], size: str, most: int, budget: int, parts: int) -> DataFrame:
    """`items` in their order with _pos, _before (the bytes before) and _segment."""
    rows = items.withColumn("_part", value_ranges(items, order[0], parts))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(size).alias("_bytes"))
    earlier = Window.orderBy(F.col("_part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sizes.select(F.col("_part").alias("_key"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_b0"))
    own = Window.partitionBy("_part").orderBy(*order)
    rows = rows.withColumn("_i", F.row_number().over(own) - 1).withColumn("_b", F.coalesce(F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(F.broadcast(offsets), F.col("_part").eqNullSafe(F.col("_key")))  # a row per range
    rows = rows.withColumn("_pos", F.col("_n0") + F.col("_i")).withColumn("_before", (F.col("_b0") + F.col("_b")).cast("long"))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    spacing = max(SPACING, -(-SEGMENT_ITEMS // most))
    weight = (exact("_before") * most + exact("_pos") * budget) / F.lit(spacing * most * budget).cast("decimal(38,0)")
    return rows.withColumn("_segment", F.floor(weight).cast("long")).drop("_part", "_key", "_n0", "_b0", "_i", "_b")


def batched(items: DataFrame, order: list[str], size: str, most: int = MOST_ITEMS, budget: int = int(MOST_BYTES * BYTES_MARGIN), parts: int = 64) -> DataFrame:
    """`items` with `batch`, numbered from 0 in the order of `order` (the first of which is a number or time, all together unique).

    Items larger than `budget` are left out of all batches and have none; a null size counts as 0. Other columns stay.
    """
    if most < 1 or budget < 1:
        raise ValueError("a batch holds at least an item and a byte")
    spark = items.sparkSession
    sized = items.withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("long"))
    folder = scratch(spark, "batches")
    placed(sized.where(F.col("_size") <= budget), order, "_size", most, budget, parts).write.parquet(f"{folder}/items")
    rows = lambda: spark.read.parquet(f"{folder}/items").select(F.col("_segment").alias("segment"), F.col("_pos").alias("pos"), F.col("_before").alias("before"), F.col("_size").alias("size"))

    def leaving(own: pd.DataFrame) -> pd.DataFrame:
        found = Segment(own, most, budget)
        last = np.unique(found.exits()[0][: found.next[0] + 1])  # no batch that comes in ends later than one that starts here
        return pd.DataFrame({"segment": int(own["segment"].iloc[0]) + 1, "carry": found.first + last, "bytes": found.before[last]})

    rows().groupBy("segment").applyInPandas(leaving, "segment long, carry long, bytes long").write.parquet(f"{folder}/carries")
    carries = spark.read.parquet(f"{folder}/carries")

    def through(own: pd.DataFrame, coming: pd.DataFrame) -> pd.DataFrame:
        """A row per carry: the start that leaves, and how many batches start here."""
        empty = pd.DataFrame({"segment": [], "carry": [], "leaves": [], "starts": [], "first": []}, dtype="int64")
        if not len(own):
            return empty
        found, number = Segment(own, most, budget), int(own["segment"].iloc[0])
        last, jumps = found.exits()
        if number == 0:
            return pd.DataFrame({"segment": [0], "carry": [-1], "leaves": found.first + last[:1], "starts": 1 + jumps[:1], "first": [0]})
        first = found.end(coming["carry"].to_numpy(np.int64), coming["bytes"].to_numpy(np.int64))
        inside, at = first < found.n, np.minimum(first, found.n - 1)
        return pd.DataFrame({"segment": number, "carry": coming["carry"].to_numpy(), "leaves": np.where(inside, found.first + last[at], coming["carry"]), "starts": np.where(inside, 1 + jumps[at], 0), "first": first})

    ways = rows().groupBy("segment").cogroup(carries.groupBy("segment")).applyInPandas(through, "segment long, carry long, leaves long, starts long, first long")
    ways.write.parquet(f"{folder}/ways")
    ways = spark.read.parquet(f"{folder}/ways")
    on_way = followed(ways, folder)

    def numbered(own: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"_pos": [], "batch": []}, dtype="int64")
        own = own.sort_values("pos")
        starts = Segment(own, most, budget).starts(int(way["first"].iloc[0]))
        return pd.DataFrame({"_pos": own["pos"].to_numpy(), "batch": int(way["done"].iloc[0]) - 1 + np.cumsum(starts)})

    found = rows().groupBy("segment").cogroup(on_way.groupBy("segment")).applyInPandas(numbered, "_pos long, batch long")
    kept = spark.read.parquet(f"{folder}/items").drop("_segment", "_before", "_size").join(found, "_pos").drop("_pos")
    return kept.unionByName(sized.where(F.col("_size") > budget).drop("_size").withColumn("batch", F.lit(None).cast("long")))


def followed(ways: DataFrame, folder: str) -> DataFrame:
    """(segment, first, done): of `ways` those that the first segment's leads to, with the batches that start before, by doubling."""
    spark = ways.sparkSession
    last = ways.agg(F.max("segment")).first()[0]
    keep = lambda df, name: (df.write.parquet(f"{folder}/{name}"), spark.read.parquet(f"{folder}/{name}"))[1]
    jump = ways.select("segment", "carry", (F.col("segment") + 1).alias("to"), "leaves", "starts")
    found = ways.where("segment = 0").select("segment", "carry", F.lit(0).cast("long").alias("done"))
    step = 1
    while last is not None and step <= last:
        ahead = found.join(jump, ["segment", "carry"]).select(F.col("to").alias("segment"), F.col("leaves").alias("carry"), (F.col("done") + F.col("starts")).alias("done"))
        found = keep(found.unionByName(ahead.where(F.col("segment") <= last)), f"found-{step}")
        second = jump.select(F.col("segment").alias("to"), F.col("carry").alias("leaves"), F.col("to").alias("_to"), F.col("leaves").alias("_leaves"), F.col("starts").alias("_starts"))
        jump = keep(jump.join(second, ["to", "leaves"]).select("segment", "carry", F.col("_to").alias("to"), F.col("_leaves").alias("leaves"), (F.col("starts") + F.col("_starts")).alias("starts")), f"jump-{step}")
        step *= 2
    return found.join(ways.select("segment", "carry", "first"), ["segment", "carry"]).select("segment", "first", "done")
