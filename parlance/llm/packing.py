"""Best-fit packing of documents into bins of `capacity` words, under conflicts.

A bin holds at most one document of a source and at most one of a duplicate cluster, so that a training
sequence mixes sources and never repeats itself. Pieces are placed longest first (ties: doc_id, piece). Open
bins are kept in order of their free space; a bin carries two bitmaps, of its sources and of its clusters.
The search starts at the successor of the piece's length, the tightest bin with room, and goes on upwards
until a bin's bitmaps don't hold the piece's source or cluster; if none is left, a new bin opens. Documents
of more words than a bin are cut: full bins of their own first, then the rest as one more piece.

Documents are dealt by a hash of the id into shards of about `shard` documents, each packed by itself, so a
hot source or a large cluster is spread over all shards in proportion, and no task holds more than a shard's
rows (id, length, source, cluster; never texts). Equal rows of these four are counted with partial aggregation and
dealt out evenly, number by number, so that a repeated or missing id crowds no shard. A shard's last bins are the only ones that a global packing
could fill better.

Lengths are counts of words between white space. A cluster is the hash of the words in lower case, so exact
copies but for case and spacing conflict; pass a column `cluster` for other groups.

Defined results: null or empty texts have length 0 and are placed like any other, as (0, 0). Null sources and
null clusters never conflict. Null ids are placed, apart from those with ids; repeated rows are pieces of
their own, with equal (doc_id, start, end). Extra columns are left out. An empty table gives no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, bin_id string, position int, start long, end long, bin_words long"


def words(text: Column) -> Column:
    """Words of a text between ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, length, source, cluster) of `docs` (doc_id, text, source; cluster if it has one)."""
    split = docs.select("doc_id", "source", *(["cluster"] if "cluster" in docs.columns else []), words(F.lower("text")).alias("w"))
    cluster = F.col("cluster").cast("string") if "cluster" in docs.columns else F.when(F.size("w") > 0, F.xxhash64("w").cast("string"))
    return split.select("doc_id", F.size("w").cast("long").alias("length"), F.col("source").cast("string").alias("source"), cluster.alias("cluster"))


def place(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of every piece (length, source's bit, cluster's bit; bit 0: none), in the order given."""
    open_bins: list[tuple[int, int]] = []  # (free, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in pieces:
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins) and (sources[open_bins[at][1]] & source or clusters[open_bins[at][1]] & cluster):
            at += 1
        if at < len(open_bins):
            free, found = open_bins.pop(at)
        else:
            free, found = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[found] |= source
        clusters[found] |= cluster
        insort(open_bins, (free - length, found))
        out.append(found)
    return out


def bits(values: pd.Series) -> list[int]:
    """A bit of its own for each value that occurs more than once; others conflict with nothing and get 0."""
    often = values.map(values.value_counts())
    order = {v: 1 << i for i, v in enumerate(sorted(values[often > 1].unique()))}
    return [order.get(v, 0) for v in values]


def pack(docs: DataFrame, capacity: int = 2048, shard: int = 4096) -> DataFrame:
    """One row per piece: doc_id, bin_id, position in the bin, start and end in words, words of the bin."""
    rows = measured(docs)
    shards = max(1, -(-rows.count() // shard))
    # equal rows follow each other from shard to shard
    once = rows.groupBy("doc_id", "length", "source", "cluster").agg(F.count("*").alias("n"))
    zero, step = F.lit(0).cast("long"), F.lit(1 << 16).cast("long")  # in two steps, so that no array is long
    each = once.withColumn("j", F.explode(F.sequence(zero, F.col("n") - 1, step)))
    each = each.withColumn("i", F.explode(F.sequence(F.col("j"), F.least(F.col("j") + step, "n") - 1)))
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("doc_id", "length", "source", "cluster") + F.col("i"), F.lit(shards)).cast("int")).drop("n", "i", "j")

    def pack_shard(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "length", "source", "cluster"], kind="stable", na_position="last", ignore_index=True)
        full = (group["length"] // capacity).tolist()
        rest = (group["length"] % capacity).tolist()
        out, prefix, n = [], f"{key[0]}-", 0
        ids = group["doc_id"].tolist()
        for i, times in enumerate(full):
            for k in range(times):
                out.append((ids[i], f"{prefix}{n}", 0, k * capacity, (k + 1) * capacity, capacity))
                n += 1
        left = [i for i in range(len(ids)) if rest[i] or not full[i]]
        left.sort(key=lambda i: -rest[i])
        source, cluster = bits(group["source"]), bits(group["cluster"])
        bins = place([(rest[i], source[i], cluster[i]) for i in left], capacity)
        used: dict[int, list[int]] = {}
        for i, b in zip(left, bins):
            used.setdefault(b, []).append(i)
        for b, members in used.items():
            total = sum(rest[i] for i in members)
            for position, i in enumerate(members):
                out.append((ids[i], f"{prefix}{n + b}", position, full[i] * capacity, full[i] * capacity + rest[i], total))
        return pd.DataFrame(out, columns=["doc_id", "bin_id", "position", "start", "end", "bin_words"]).astype({"doc_id": "Int64"})

    return dealt.groupBy("shard").applyInPandas(pack_shard, PIECES)
