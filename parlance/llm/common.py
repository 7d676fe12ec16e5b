"""What the training-data operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.session import remove, scratch, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(column: str, k: int) -> Column:
    """crc32 of the id's text modulo k: the folds of the labelled operators (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % k


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back, so that lost executors do not undo it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of `df` but those called like one of `names`, in any case, quoted for select()."""
    taken = {n.lower() for n in names}
    return [f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in taken]


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it until no column of `df` is called so, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def batches(texts: pd.Series, most: int = 4_000_000) -> Iterator[pd.Series]:
    """Parts of a batch with about `most` characters each; a longer text is a part of its own."""
    ends = texts.str.len().fillna(0).cumsum() // most
    for _, part in texts.groupby(ends, sort=False):
        yield part


class Subwords:
    """Hashed features of words: the character n-grams of <word> and, if `whole`, each word itself.

    A polynomial hash over code points, computed for many words at once.
    """

    def __init__(self, low: int, high: int, buckets: int, whole: bool = True):
        self.low, self.high, self.buckets, self.whole = low, high, buckets, whole

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(owner, id): for every feature the position of its word in `words`, and its bucket."""
        codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(words)), sizes)
        left = ends[owner] - np.arange(len(codes))  # characters from here to the end of the word
        at = sizes[owner] - left
        owners, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        with np.errstate(over="ignore"):
            if self.whole and len(words):
                power = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
                owners.append(np.arange(len(words)))
                ids.append(self._bucket(np.add.reduceat(codes * power[at], ends - sizes), 1))
            rolling = codes.copy()
            for n in range(2, self.high + 1):
                rolling = rolling[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
                if n >= self.low:
                    inside = left[: len(rolling)] >= n
                    owners.append(owner[: len(rolling)][inside])
                    ids.append(self._bucket(rolling[inside], n + 1))
        return np.concatenate(owners), np.concatenate(ids)

    def _bucket(self, h: np.ndarray, salt: int) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * salt)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(self.buckets)).astype(np.int64)

    def apart(self, words: list[str]) -> list[np.ndarray]:
        """The feature ids of each word."""
        owner, ids = self(words)
        order = np.argsort(owner, kind="stable")
        return np.split(ids[order].astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(words)))[:-1]) if words else []


class Lexicon:
    """Rows of numbers for words, `rows(words)` computed when words first occur and then kept.

    Beyond `keep` words the store starts anew, so memory is bounded.
    """

    def __init__(self, rows: Callable[[list[str]], np.ndarray], keep: int = 400_000):
        self.rows, self.keep = rows, keep
        self.index: dict[str, int] = {}
        self.values: np.ndarray | None = None
        self.used = 0

    def __call__(self, words: list[str]) -> np.ndarray:
        """A row for each of `words`."""
        new = list(set(words).difference(self.index))
        if new:
            if self.used + len(new) > self.keep:
                self.index, self.values, self.used = {}, None, 0
                new = list(set(words))
            made = self.rows(new)
            if self.values is None or self.used + len(new) > len(self.values):
                grown = np.zeros((max(2 * self.used, self.used + len(new), 1024), *made.shape[1:]), made.dtype)
                if self.used:
                    grown[: self.used] = self.values[: self.used]
                self.values = grown
            self.values[self.used : self.used + len(new)] = made
            self.index.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return self.values[at] if len(at) else self.rows([])


def sums(values: np.ndarray, sizes: list[int] | np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of rows; an empty group gives 0."""
    ends = np.cumsum(sizes)
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends] - total[ends - np.asarray(sizes)]


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


#: Longer texts are scored like all others, but no classifier learns from them, so that a sample's size is bounded.
LONGEST = 1 << 19
#: Characters that a sample holds in all; documents behind that, in the order in which they are drawn, are left out of it.
MOST_CHARACTERS = 1 << 28


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int = 5, longest: int = LONGEST, characters: int = MOST_CHARACTERS) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y): at most `per_class` labelled documents of each class outside fold 0, those
    with the smallest hash of the id; and how many there are of each class in all.

    The bounds are the operator's parameters, `characters` that of all texts together. Ids are drawn from `labels` alone; texts follow by a join
    in which at most 2 x per_class ids (16 bytes each) are broadcast. Of the rows of one id one is learned from
    (the smallest text of at most `longest` characters; null ones if there is no other), picked with partial aggregation. Null
    labels, ids and labels other than 0 and 1 take no part; repeated labels of a document count once (the largest).
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != 0))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    )
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    fine = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    sample = fine.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    # at most 2 x per_class rows, which one task fits in any case
    upto = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    return sample.withColumn("_upto", upto).where(F.col("_upto") <= characters).drop("_upto"), totals


def class_weights(y: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """For each drawn label, its class's share among all labels over its share in the sample."""
    drawn = np.bincount(y, minlength=2) / max(1, len(y))
    share = np.array([totals[0], totals[1]], float) / sum(totals.values())
    return (share / np.maximum(drawn, 1e-9))[y]


def fit_in_task(sample: DataFrame, fit: Callable[[pd.DataFrame], object]) -> object:
    """What `fit` makes of a bounded sample, made in one task of an executor and sent to the driver.

    The sample's rows are sorted by doc_id first, so the result doesn't depend on how they arrive.
    """

    none = pd.DataFrame({"doc_id": [], "text": [], "y": np.zeros(0, int)})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([none, *parts], ignore_index=True).astype({"y": int}).sort_values("doc_id", kind="stable", ignore_index=True)
        yield pd.DataFrame({"model": [pickle.dumps(fit(rows))]})

    made = sample.repartition(1).mapInPandas(run, "model binary").first()  # an empty sample may have no task at all
    return pickle.loads(made["model"]) if made else fit(none)
