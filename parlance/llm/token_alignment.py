"""Alignment of two tokenizers' tokens over the bytes of a text.

Text is encoded by a byte-level BPE (A, of space + text) and by a SentencePiece model (B, which adds the space). The byte
offsets where tokens end are marked in two packed bitsets; their conjunction holds the shared cuts, which split a text into groups. A
directory of the bitsets' population counts tells how many tokens end up to a cut (rank), which gives each group's
range of tokens on either side; then a group's links expand: every A token with every B token of it.

How many documents hold an id pair linked is counted over the whole table:

1. One pass encodes and links. Documents are gathered into blocks of about `block` characters; a block keeps a list of its
   distinct id pairs with the number of its documents that hold each, and a document refers to that list. Both go to
   a table in the shared folder, so no text is encoded twice.
2. The blocks' lists, which have a pair once per block however many documents hold it, are summed by id pair, and the sums
   are joined back to them. The highest count of each A id is broadcast: at most a row per id of the vocabulary.
3. A block's documents meet its list again, and counts are summed up per document.

Expanding stops at LINKS links at a time and goes on after they are counted, so that a group of many tokens on both
sides takes time but no memory beyond its distinct pairs.

Defined results: a text that is null or empty, or whose bytes either tokenizer doesn't give back, has no tokens: zeros, and an
empty hash. Rows that repeat an id or have none are documents of their own. Very long texts are encoded in parts, with the same ids. Other
columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import batches, scratch
from parlance.llm.tokens import byte_level, pieces

LINKS, LIST = 1 << 22, 1 << 16


class Bits:
    """A packed bitset with a directory of its words' population counts."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def marking(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-size // 64) * 64, np.uint8)
        marks[places] = 1
        return cls(np.packbits(marks, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many marks stand up to each of `places`, itself included."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        up_to = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
        return self.before[word] + np.bitwise_count(up_to)

    def places(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Aligned:
    """The texts of a batch, one after another: tokens of both sides, and the groups' numbers of them.

    docs_a, docs_b, docs_g: tokens and groups of each text; in_a, in_b: tokens of each group.
    """

    def __init__(self, texts: list[str | None], byte_path: str, piece_path: str):
        a, b = byte_level(byte_path), pieces(piece_path)
        whole = [(" " + t).encode() if t else b"" for t in texts]
        own_a, own_b = a([w.decode() for w in whole]), b([t or "" for t in texts])
        for i, w in enumerate(whole):
            if not w or any(b"".join(map(side.bytes.__getitem__, ids.tolist())) != w for side, ids in ((a, own_a[i]), (b, own_b[i]))):
                whole[i], own_a[i], own_b[i] = b"", own_a[i][:0], own_b[i][:0]
        self.a, self.b = (np.concatenate([np.zeros(0, np.uint32), *own]).astype(np.int64) for own in (own_a, own_b))
        self.docs_a, self.docs_b = (np.array([len(x) for x in own], np.int64) for own in (own_a, own_b))
        self.sizes = len(a.bytes), len(b.bytes)
        bytes_of = [np.fromiter(map(len, side.bytes), np.int64, len(side.bytes)) for side in (a, b)]
        ends = [np.cumsum(n[ids]) - 1 for n, ids in zip(bytes_of, (self.a, self.b))]
        text_bytes = np.array([len(w) for w in whole], np.int64)
        total = int(text_bytes.sum())
        bits = [Bits.marking(e, total) for e in ends]
        cuts = (bits[0] & bits[1]).places()
        self.in_a, self.in_b = (np.diff(x.rank(cuts), prepend=0) for x in bits)
        self.docs_g = np.diff(np.searchsorted(cuts, np.cumsum(text_bytes)), prepend=0)

    def links(self) -> np.ndarray:
        """Links of each text."""
        return per(self.in_a * self.in_b, self.docs_g)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, code, times): the distinct linked id pairs of each text, and how many links are of each.

        A pair's code is its A id times the B ids' number plus its B id.
        """
        group = np.repeat(np.arange(len(self.in_a)), self.in_a)
        text = np.repeat(np.arange(len(self.docs_a)), self.docs_a)
        first = (np.cumsum(self.in_b) - self.in_b)[group]
        width = self.in_b[group]
        upto = np.cumsum(width)
        span = self.sizes[0] * self.sizes[1]
        keys, times, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while start < len(width):
            done = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, done + LINKS, "right")))
            w = width[start:stop]
            owner = np.repeat(np.arange(start, stop), w)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(w) - w, w) + first[owner]
            key, n = counted(text[owner] * span + self.a[owner] * self.sizes[1] + self.b[place])
            keys.append(key)
            times.append(n)
            start = stop
        key, n = np.concatenate(keys), np.concatenate(times)
        if len(keys) > 2:
            key, n = counted(key, n)
        return key // span, key % span, n

    def said(self) -> list[str]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`, hashed; '' without tokens."""
        ids = np.concatenate([self.a, self.b])
        place = np.concatenate([np.arange(len(self.a)) + np.repeat(np.cumsum(self.in_b) - self.in_b, self.in_a), np.arange(len(self.b)) + np.repeat(np.cumsum(self.in_a), self.in_b)])
        after = np.full(len(ids), ord(","), np.uint8)
        after[np.cumsum(self.in_a) - 1] = ord("|")
        after[len(self.a) + np.cumsum(self.in_b) - 1] = ord(";")
        merged, ending = np.empty(len(ids), np.int64), np.empty(len(ids), np.uint8)
        merged[place], ending[place] = ids, after
        shown, width = decimals(max(self.sizes))
        w = width[merged]
        ends = np.cumsum(w + 1)
        start = ends - w - 1
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        for k in range(shown.shape[1]):
            has = w > k
            out[start[has] + k] = shown[merged[has], k]
        out[ends - 1] = ending
        upto = np.concatenate([[0], ends])[np.cumsum(self.docs_a + self.docs_b)]
        view = memoryview(out)
        return [hashlib.sha256(view[i : j - 1]).hexdigest() if j > i else "" for i, j in zip([0, *upto.tolist()], upto.tolist())]


def per(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Integer sums of consecutive groups of `values`."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.cumsum(sizes)], prepend=0)


def counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs, or the sum of its `times`."""
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]])[: len(keys)])
    if times is None:
        return keys[first], np.diff(first, append=len(keys))
    return keys[first], np.add.reduceat(times, first) if len(first) else times[:0]


def decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below `most`, from the left, and how many each has."""
    places = len(str(most))
    n = np.arange(most)
    width = np.maximum(1, (n[:, None] >= 10 ** np.arange(places)).sum(axis=1))
    power = np.maximum(width[:, None] - 1 - np.arange(places), 0)
    return (ord("0") + n[:, None] // 10**power % 10).astype(np.uint8), width


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_sizes, b_sizes): tokens of `docs` (doc_id, text) and the sizes of their groups."""

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for texts in batches(batch.column("text").to_pandas()):
                x = Aligned(texts.tolist(), byte_path, piece_path)
                ids = batch.column("doc_id").take(pa.array(texts.index))
                yield pa.RecordBatch.from_arrays([ids, lists(x.a, x.docs_a), lists(x.b, x.docs_b), lists(x.in_a, x.docs_g), lists(x.in_b, x.docs_g)], names=["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])

    return texts_of(docs).mapInArrow(task, "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>")


#: A row is a document (refs, times: its pairs' places in the block's list, and links of each) or a stretch of a block's list
#: (from its place `first` on: A ids, B ids, documents of the block).
LINKED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, refs array<int>, times array<int>, first int, a array<int>, b array<int>, n array<int>"
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def linked(docs: DataFrame, byte_path: str, piece_path: str, block: int = 1 << 23) -> DataFrame:
    """Rows of LINKED: every document and every block's list of pairs."""
    schema = arrow_schema(LINKED)

    def row_batch(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def told(number: int, own: list[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """A block's rows of its batches (columns, pairs of each text, codes, times)."""
        codes = np.concatenate([x[2] for x in own])
        known, refs, n = np.unique(codes, return_inverse=True, return_counts=True)
        at = 0
        for columns, sizes, code, times in own:
            yield row_batch(len(sizes), block=pa.array(np.full(len(sizes), number)), refs=lists(refs[at : at + len(code)], sizes), times=lists(times, sizes), **columns)
            at += len(code)
        span = pieces_in(piece_path)
        for k in range(0, len(known), LIST):
            one = np.array([len(known[k : k + LIST])])
            part, docs_of = known[k : k + LIST], n[k : k + LIST]
            yield row_batch(1, block=pa.array([number]), first=pa.array([k], pa.int32()), a=lists(part // span, one), b=lists(part % span, one), n=lists(docs_of, one))

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own, gathered = TaskContext.get().partitionId() << 32, [], 0
        for batch in rows:
            for texts in batches(batch.column("text").to_pandas(), block // 4):
                x = Aligned(texts.tolist(), byte_path, piece_path)
                text, code, times = x.pairs()
                counts = {"n_a": x.docs_a, "n_b": x.docs_b, "n_groups": x.docs_g, "n_links": x.links()}
                columns = {k: pa.array(v) for k, v in counts.items()} | {"doc_id": batch.column("doc_id").take(pa.array(texts.index)), "groups_sha256": pa.array(x.said(), pa.string())}
                own.append((columns, np.bincount(text, minlength=len(texts)), code, times))
                gathered += int(texts.str.len().fillna(0).sum())
                if gathered >= block:
                    yield from told(number, own)
                    number, own, gathered = number + 1, [], 0
        if own:
            yield from told(number, own)

    return texts_of(docs).mapInArrow(task, LINKED)


def pieces_in(piece_path: str) -> int:
    return len(pieces(piece_path).bytes)


def link_counts(known: DataFrame) -> DataFrame:
    """(a, b, count): in how many documents an id pair is linked, of rows (a, b, n) of the blocks' lists."""
    return known.groupBy("a", "b").agg(F.sum("n").alias("count"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def digest(docs: DataFrame, byte_path: str, piece_path: str, block: int = 1 << 23) -> DataFrame:
    """A row of RESULT for each of `docs` (doc_id, text).

    n_best: links whose pair's count is the highest of its A id; count_sum: the counts of all links' pairs, added up.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "alignment")
    linked(docs, byte_path, piece_path, block).write.parquet(folder)
    listed = spark.read.parquet(folder).where("first is not null").select("block", "first", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "p"))
    known = listed.select("block", (F.col("first") + F.col("at")).alias("ref"), "p.a", "p.b", "p.n")
    counts = link_counts(known)
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # a row for each id of A's vocabulary at most
    told = known.drop("n").join(counts, ["a", "b"]).join(F.broadcast(highest), "a").select("block", "ref", "count", (F.col("count") == F.col("highest")).alias("best"))
    schema = arrow_schema(RESULT)

    def summed(own: pa.Table, pairs: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        count, best = np.zeros((2, len(pairs)), np.int64)
        ref = pairs.column("ref").to_numpy()
        count[ref], best[ref] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
        sizes = pc.list_value_length(own.column("refs")).to_numpy().astype(np.int64)
        refs, times = (pc.list_flatten(own.column(c)).to_numpy().astype(np.int64) for c in ("refs", "times"))
        made = {"n_best": pa.array(per(times * best[refs], sizes)), "count_sum": pa.array(per(times * count[refs], sizes))}
        return pa.table([made[f.name] if f.name in made else own.column(f.name) for f in schema], schema=schema)

    texts = spark.read.parquet(folder).where("first is null").select("block", *[f.name for f in schema if f.name not in ("n_best", "count_sum")], "refs", "times")
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(summed, RESULT)
