"""Connected components of a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of `links` (a long, b long) the smallest node it is linked to.

    Alternating large-star and small-star steps: each node's larger neighbours, then the others, are
    linked to the smallest neighbour, until nothing changes, however long that takes. The number of links
    never grows, and O(log^2 n) steps suffice. Each step sends a node's neighbours through one pre-aggregated minimum
    and one join on the node, which adaptive execution splits for nodes with many neighbours; no
    group is collected. State is written to the checkpoint folder after every round.
    """
    links = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        links = cut_lineage(small.distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
