"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives a vector a long string of LENGTH hash characters. Character k is the index and sign of the
k-th largest coordinate after the tree's random rotation (a cross-polytope hash, carried on; near vectors agree
far more often than under random hyperplanes). A tree is the sorted array of its vectors' strings; a query
descends it to the longest prefix that anything shares with its own string, by binary search per prefix length.
Then all trees ascend together, one character at a time, and give the vectors that share the shorter prefix,
until `share` of the rows (and more than k) are gathered or the root is reached. All vectors of the last level
are taken, never a part of them, so equal vectors are found together. Candidates are compared by exact cosine.
`share` is the same at every size, so the forest works alike on small and large tables.

Vectors are dealt into shards of about `shard` rows, each with a forest of its own, and queries, a stated set,
into blocks of about `block`; every pair of a shard and a block is a group of its own on the cluster, so that
neither the driver nor a task ever holds more than a shard and a block. Each group gives its k nearest per
query; a window per query takes the k nearest of those. Rotations depend on `seed` alone, so nothing is fitted,
and every row is indexed. Rows are dealt by a hash of id and vector. Equal rows are counted first (with partial
aggregation), and of n such rows min(n, k) are indexed, as no result could hold more; so nothing that repeats
crowds a shard.

Defined results: vectors that are null, zero, or have null or non-finite components take no part, and
neither do null ids. Vectors of another length than the query's are no candidates. Ties go to the smaller
vec_id. Rows that repeat a vec_id are separate candidates, but never of their own id; a vec_id asked for by
several rows gets the nearest of all of them. Fewer than k candidates give all of them. Extra columns are left
out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, LENGTH = 80, 8


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))


def normed(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # very large or small components keep their precision
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def strings(x: np.ndarray, trees: int, length: int, seed: int) -> np.ndarray:
    """(trees, rows): the hash strings as numbers whose leading digits are the leading characters."""
    size = x.shape[1]
    length = characters(size, length)
    out = np.zeros((trees, len(x)), np.int64)
    short, rows = x.astype(np.float32), np.arange(len(x))[:, None]
    for t in range(trees):
        rotation, _ = np.linalg.qr(np.random.default_rng([seed, t, size]).standard_normal((size, size)))
        turned = short @ rotation.astype(np.float32)
        far = np.abs(turned)
        top = np.argpartition(-far, length - 1, axis=1)[:, :length] if length < size else np.tile(np.arange(size), (len(x), 1))
        top = top[rows, np.argsort(-far[rows, top], axis=1, kind="stable")]
        for digit in (2 * top + (turned[rows, top] > 0)).T:
            out[t] = out[t] * (2 * size) + digit
    return out


def characters(size: int, length: int) -> int:
    """How many characters of an alphabet of 2 x size fit into 62 bits, at most `length` and one per coordinate."""
    return max(1, min(length, size, int(62 / np.log2(2 * size))))


class Forest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES, length: int = LENGTH, seed: int = 1):
        self.ids, self.unit = ids, normed(vectors)
        self.seed, self.base = seed, 2 * vectors.shape[1]
        self.length = characters(vectors.shape[1], length)
        found = strings(self.unit, trees, length, seed)
        self.order = np.argsort(found, axis=1, kind="stable")
        self.sorted = np.take_along_axis(found, self.order, axis=1)

    def levels(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length + 1, trees, queries): the range of rows that share the first k characters, k = 0, 1, ..."""
        low = np.zeros((self.length + 1, *asked.shape), np.int64)
        high = np.full(low.shape, self.sorted.shape[1])
        for k in range(1, self.length + 1):
            rest = self.base ** (self.length - k)
            for t in range(len(asked)):
                start = asked[t] // rest * rest
                low[k, t] = np.searchsorted(self.sorted[t], start)
                high[k, t] = np.searchsorted(self.sorted[t], start + rest)
        return low, high

    def gathered(self, low: np.ndarray, high: np.ndarray, enough: int) -> tuple[int, np.ndarray]:
        """(level, rows): all trees' rows at the deepest level where they are at least `enough`; at the root all.

        low, high: (length + 1, trees), the ranges of one query.
        """
        width = (high - low).sum(axis=1)
        for level in range(self.length, 0, -1):
            if width[level] >= enough:
                taken = np.zeros(len(self.ids), bool)
                for t in np.flatnonzero(high[level] > low[level]):
                    taken[self.order[t, low[level, t] : high[level, t]]] = True
                rows = np.flatnonzero(taken)
                if len(rows) >= enough:
                    return level, rows
        return 0, np.arange(len(self.ids))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's position, ids, cosines) of its k nearest candidates, nearest first."""
        unit = normed(queries)
        low, high = self.levels(strings(unit, len(self.sorted), self.length, self.seed))
        enough = max(k + 1, int(np.ceil(share * len(self.ids))))
        for q in range(len(queries)):
            _, rows = self.gathered(low[:, :, q], high[:, :, q], enough)
            rows = rows[self.ids[rows] != own[q]]
            cosine = self.unit[rows] @ unit[q]
            if len(rows) > k:  # all that tie with the k-th stay for the ties
                edge = np.partition(cosine, len(rows) - k)[len(rows) - k]
                near = cosine >= edge - 1e-12
                rows = rows[near]
            cosine = (self.unit[rows] * unit[q]).sum(axis=1)  # equal vectors give equal sums here
            best = np.lexsort((self.ids[rows], -cosine))[:k]
            yield q, self.ids[rows[best]], cosine[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float = 0.1, shard: int = 8192, block: int = 1 << 15, trees: int = TREES, seed: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for every row of `queries`.

    Both frames have vec_id and embedding. A query's own vec_id is no candidate.
    """
    shards, blocks = (max(1, -(-usable(df).count() // most)) for df, most in ((vectors, shard), (queries, block)))

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        """Distinct rows with their number, their part and, once for each, every part of the other side."""
        rows = usable(df).groupBy("vec_id", "embedding").agg(F.count("*").alias("n"))
        place = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(parts)).cast("int")
        return rows.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("shard", "block")

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = rows.loc[rows.index.repeat(rows["n"].clip(upper=k))]
        for size, own in asked.groupby(asked["embedding"].map(len)):
            same = rows[rows["embedding"].map(len) == size]
            if len(same):
                forest = Forest(same["vec_id"].to_numpy(), np.stack(same["embedding"]), trees=trees, seed=seed)
                ids = own["vec_id"].to_numpy()
                out += [(np.repeat(ids[q], len(found)), found, cosine) for q, found, cosine in forest.search(ids, np.stack(own["embedding"]), k, share)]
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    pairs = dealt(vectors, "shard", shards, "block", blocks).cogroup(dealt(queries, "block", blocks, "shard", shards))
    found = pairs.applyInPandas(search, "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
