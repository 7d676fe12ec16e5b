"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints: A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`, and every 3-word shingle, repeats
included, votes with its XXH64 (UTF-8, seed 42); bit i is set if over half of the hashes have it. Fewer
than three words give one shingle, none give fingerprint zero.

Linking: documents with equal fingerprints are one leaf of the trie. The trie is walked in pairs of
nodes: both nodes of a pair are at one depth, the bits in which their paths differ are counted, and a
pair is dropped as soon as they are more than `budget`. The first `depth` bits are walked by Spark: a
fingerprint goes to every pair of subtrees its prefix can be part of (an explode of at most
1 + depth + C(depth, 2) masks), so pairs of subtrees are groups, dealt over the cluster. Inside a group
numpy walks on, a level at a time over the whole frontier of node pairs. `depth` follows the number of
fingerprints so that subtrees hold about `subtree` of them. A prefix with more than `most` of them (near
copies share a prefix) is cut into slices by a hash, and pairs of slices become groups of their own, so a
group never holds more than about 2 x `most` rows and no pair is lost.

A group gives a spanning forest of its links rather than all links, so that output stays linear in its
input however dense a group of near copies is; the components are those of all links.

Defined results: a null text counts as empty. A null doc_id is kept; it never becomes a component_id, which
is null only if no document reachable has an id. Repeated rows stay repeated. Input columns called like
an output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import cut_lineage, without
from parlance.llm.components import components

BITS, SEED, WORDS = 64, 42, 3


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not found:
        return 0
    # every shingle is a slice of the words joined once
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(found))
    view, h = memoryview(joined), xxhash.xxh64_intdigest
    last = ends[width - 1 :].tolist()
    counts, n = np.zeros(BITS, np.int64), len(last)
    for at in range(0, n, 65536):
        hashes = np.array([h(view[s:e], SEED) for s, e in zip(starts[at : min(at + 65536, n)].tolist(), last[at : at + 65536])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, column: str = "fp") -> DataFrame:
    """`docs` with the fingerprint of its text as a signed long."""

    @F.pandas_udf(T.LongType())
    def simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select(*without(docs, column), simhash(F.col("text")).alias(column))


def join_tries(a: np.ndarray, b: np.ndarray, depth: int, budget: int, same: bool, leaf: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions (i in a, j in b) whose values differ in at most `budget` bits.

    a, b: sorted uint64, each sharing its first `depth` bits. same: a is b, and pairs have i < j.
    A frontier of node pairs goes down a bit at a time. Pairs of few values are compared at once.
    """
    lo_a, hi_a, lo_b, hi_b = (np.array([x]) for x in (0, len(a), 0, len(b)))
    spent = np.bitwise_count((a[:1] ^ b[:1]) >> np.uint64(BITS - depth)).astype(np.int64) if depth and len(a) and len(b) else np.zeros(1, np.int64)
    while len(lo_a):
        size = (hi_a - lo_a) * (hi_b - lo_b)
        if depth == BITS:
            done = np.ones(len(size), bool)
        else:
            done = size <= 64 if size.sum() > leaf else np.ones(len(size), bool)
        yield from compare(a, b, lo_a[done], hi_a[done], lo_b[done], hi_b[done], budget, same)
        lo_a, hi_a, lo_b, hi_b, spent = (x[~done] for x in (lo_a, hi_a, lo_b, hi_b, spent))
        if not len(lo_a):
            return
        one = np.uint64(1 << (BITS - 1 - depth))
        path = ~np.uint64((1 << (BITS - depth)) - 1)
        mid_a = np.searchsorted(a, (a[lo_a] & path) | one)
        mid_b = np.searchsorted(b, (b[lo_b] & path) | one)
        parts = [(lo_a, mid_a, lo_b, mid_b, spent), (mid_a, hi_a, mid_b, hi_b, spent), (lo_a, mid_a, mid_b, hi_b, spent + 1), (mid_a, hi_a, lo_b, mid_b, spent + 1)]
        lo_a, hi_a, lo_b, hi_b, spent = (np.concatenate([p[k] for p in parts]) for k in range(5))
        keep = (lo_a < hi_a) & (lo_b < hi_b) & (spent <= budget)
        if same:  # of a pair of nodes and its mirror image, one is walked
            keep &= lo_a <= lo_b
        lo_a, hi_a, lo_b, hi_b, spent = (x[keep] for x in (lo_a, hi_a, lo_b, hi_b, spent))
        depth += 1


def compare(a, b, lo_a, hi_a, lo_b, hi_b, budget: int, same: bool, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All values of each node pair against each other, some `most` comparisons at a time."""
    # one row of a against the other node's range
    rows = hi_a - lo_a
    i = np.repeat(lo_a - np.cumsum(rows) + rows, rows) + np.arange(rows.sum())
    start, width = np.repeat(lo_b, rows), np.repeat(hi_b - lo_b, rows)
    at = 0
    reach = np.cumsum(width)
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + most, "right")))
        w = width[at:to]
        left = np.repeat(i[at:to], w)
        right = np.repeat(start[at:to] - np.cumsum(w) + w, w) + np.arange(w.sum())
        near = np.bitwise_count(a[left] ^ b[right]) <= budget
        if same:
            near &= left < right
        yield left[near], right[near]
        at = to


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the smallest node that the links connect it to."""
    label = np.arange(n)
    for i, j in links:
        while True:
            li, lj = label[i], label[j]
            differ = li != lj
            if not differ.any():
                break
            i, j, li, lj = i[differ], j[differ], li[differ], lj[differ]
            low = np.minimum(li, lj)
            np.minimum.at(label, np.maximum(li, lj), low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            while (label != label[label]).any():
                label = label[label]
    return label


def masks(depth: int, budget: int) -> list[int]:
    """Differences that two prefixes of `depth` bits may have."""
    return [sum(1 << bit for bit in bits) for k in range(min(budget, depth) + 1) for bits in combinations(range(depth), k)]


def link(fps: DataFrame, budget: int = 2, subtree: int = 1 << 16, most: int = 1 << 18) -> DataFrame:
    """(a, b): links of distinct fingerprints `fps` (fp long) that span every component of them."""
    count = fps.count()
    depth = min(24, max(6, math.ceil(math.log2(max(1, count) / subtree))))
    prefix = F.shiftrightunsigned("fp", BITS - depth)
    sized = fps.select("fp", prefix.alias("p"))
    # prefixes with too many values, and into how many slices they are cut: at most count / most rows
    hot = sized.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") > most).select("p", F.ceil(F.col("n") / most).cast("int").alias("slices"))
    sized = sized.join(hot, "p", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    sized = sized.withColumn("slice", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    prefixes = cut_lineage(sized.groupBy("p", "slice").agg(F.count("*").alias("n")).select("p", "slice"))

    flip = F.explode(F.array(*[F.lit(m).cast("long") for m in masks(depth, budget)]))
    ask = prefixes.select("p", "slice", flip.alias("m")).select("p", "slice", F.col("p").bitwiseXOR(F.col("m")).alias("q"))
    pairs = ask.join(prefixes.select(F.col("p").alias("q"), F.col("slice").alias("other")), "q").where("p < q OR (p = q AND slice <= other)")
    pairs = pairs.select(F.struct("p", "slice", "q", "other").alias("pair"))
    left = pairs.select("pair.p", "pair.slice", "pair", F.lit(0).alias("side"))
    right = pairs.where("pair.p <> pair.q OR pair.slice <> pair.other").select(F.col("pair.q").alias("p"), F.col("pair.other").alias("slice"), "pair", F.lit(1).alias("side"))
    dealt = sized.select("fp", "p", "slice").join(left.unionByName(right), ["p", "slice"]).select("pair.*", "side", "fp")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy().view(np.uint64)
        side = group["side"].to_numpy()
        a, b = np.sort(fp[side == 0]), np.sort(fp[side == 1])
        if len(b):
            both = np.concatenate([a, b])
            label = forest(len(both), ((i, j + len(a)) for i, j in join_tries(a, b, depth, budget, False)))
        else:
            both = a
            label = forest(len(both), join_tries(a, a, depth, budget, True))
        linked = label != np.arange(len(label))
        return pd.DataFrame({"a": both[linked].view(np.int64), "b": both[label[linked]].view(np.int64)})

    return dealt.groupBy("p", "slice", "q", "other").applyInPandas(walk, "a long, b long")


def grouped(docs: DataFrame, row: Column, budget: int = 2, subtree: int = 1 << 16, most: int = 1 << 18, large: int = 256, listed: int = 1 << 20) -> DataFrame:
    """(doc_id, row, fp, component_id, best): `best` is the row of a component that stays, as (no id, doc_id, row).

    Fingerprints of at least `large` documents are told by a broadcast of at most `listed` of them (by count, `large`
    grows with the table), so that no task gets all the copies of a text; the others are joined.
    """
    marked = cut_lineage(with_fingerprints(docs.select("doc_id", "text", row.alias("row"))).select("doc_id", "row", "fp"))
    # equal fingerprints: one leaf with the smallest id of its documents
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    leaves = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), first, F.count("*").alias("n")))
    roots = components(link(leaves.select("fp"), budget, subtree, most))
    least = roots.join(leaves, roots["node"] == leaves["fp"]).groupBy("root").agg(F.min("least").alias("component_id"), F.min("best").alias("first"))
    linked = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id", "first")
    leaves = leaves.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("first", "best").alias("best"))
    leaves = cut_lineage(leaves)
    large = max(large, -(-marked.count() // max(1, listed)))
    hot = leaves.where(F.col("n") >= large).select("fp", F.struct("component_id", "best").alias("leaf"))
    told = marked.join(F.broadcast(hot), "fp", "left")
    names = ("doc_id", "row", "fp", "component_id", "best")
    rest = told.where("leaf IS NULL").drop("leaf").join(leaves.where(F.col("n") < large).drop("n"), "fp")
    return told.where("leaf IS NOT NULL").select("doc_id", "row", "fp", "leaf.*").select(*names).unionByName(rest.select(*names))


def near_duplicates(docs: DataFrame, **parameters: int) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs` (doc_id, text)."""
    found = grouped(docs, F.lit(0).cast("long"), **parameters)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, listed: int = 1 << 20, **parameters: int) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: the one with the smallest doc_id.

    Rows are told apart by doc_id and a hash of all their columns. Rows of one id: the one with the smaller hash stays;
    of equal rows one; rows without an id stay only in groups where none has one, and then one. Texts stay where they
    are: the dropped rows' ids and hashes are broadcast where they are at most `listed`, joined otherwise. Only rows
    that occur several times are shuffled.
    """
    key = F.xxhash64(*without(docs))
    found = cut_lineage(grouped(docs, key, listed=listed, **parameters))
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row") == F.col("best.row"))
    dropped = found.where(~kept).select("doc_id", "row").distinct()
    repeated = found.where(kept).groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "row")

    def joined(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("_id"), F.col("row").alias("_own"))
        keys = F.broadcast(keys) if keys.count() <= listed else keys
        return rows.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (key == F.col("_own")), how)

    left = joined(docs, dropped, "left_anti")
    if repeated.isEmpty():
        return left
    return joined(left, repeated, "left_anti").unionByName(joined(left, repeated, "left_semi").distinct())
