"""Language-model scores by masked pseudo-likelihood.

A network predicts every word from the `SIDE` words on both of its sides: the neighbours' embeddings, scaled by weights of
their places, are summed, a tanh layer follows, and the output is a binary decision at each node on the way to the word in a
Huffman tree of the vocabulary. The score of a document is the sum of log P(word | both sides) over all its words.

The vocabulary is counted over all words of all documents (lower case, between white space): the WORDS most
frequent ones are words of their own, every other word falls into one of HASHED classes, and its
probability is that of the class times P(word | class). That is told by the counts of all other words, kept
in hashed buckets: twice as many as there are words at least, TAIL at most, so that a broadcast stays bounded.
Words that share a bucket share its count evenly; beside them it stands for UNSEEN words not met, seen once each,
so the probabilities of all words add up to one.

The network starts from a fixed seed and is trained in numpy in rounds. In a round every partition trains on the
documents that a hash of id and text gives to this round: each document, also one without an id, is learned
from in one round, unless a smaller `share` is asked for. Every word of a document is predicted, unless a smaller share `masked`
of them, drawn anew for every text, is asked for; the others are then only seen beside them. Small partitions are put together until a task has LEAST
words. Then every row of the parameters (a word's embedding, a node, a place) is
averaged over the partitions, weighted by how often each has met it, so that a word which few partitions hold
learns as fast as others. Blocks of rows are averaged apart, in two levels of Spark aggregation; the driver gets one
set of parameters. Averages depend on how the input is split into partitions, so scores are the same for the same files and split sizes.

Defined results: a null or empty text has 0 words, log-likelihood 0 and no mean. Long texts are scored whole
in pieces that overlap by SIDE. Rows that repeat an id or have none are scored and learned from one by one. Input columns called like
an output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, repeat
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import batches, cut_lineage, sums, unused, without

SIDE, WIDTH = 2, 16
#: Words and hashed classes; with the padding they are numbered in 16 bits. MASKED is the share of words that training predicts: all.
WORDS, HASHED = (1 << 16) - (1 << 10) - 1, 1 << 10
MASKED = 1.0
TAIL, SLICES, UNSEEN = 1 << 20, 64, 0.1
STEP, HEAVY, SHORT, TINY = 2048, 128, 4, 1e-300
#: Words that a task learns from in a round at least, as every task sends all its parameters.
LEAST = 500_000
#: Lots that documents draw, which decide on their round.
LOTS = 1 << 20
ZERO = np.zeros(1, np.int64)
PLACES = [*range(-SIDE, 0), *range(1, SIDE + 1)]


def split_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): every word of all texts, and how often it occurs."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> list[tuple[str, int]]:
    """The `size` most frequent words and their counts, by falling count, ties by the word.

    How many words have which count, in steps of a twentieth, tells a count that enough words reach; only those
    words are sorted, so that partitions don't send `size` words each to the driver.
    """
    step = F.floor(F.log(F.col("n").cast("double")) * 20)
    sizes = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    reached = np.cumsum([n for _, n in sizes])
    at = min(int(np.searchsorted(reached, size)), len(sizes) - 1)
    enough = counts.where(step >= sizes[at][0]) if sizes else counts
    return [(r["word"], r["n"]) for r in enough.orderBy(F.desc("n"), "word").limit(size).collect()]


def vocabulary(docs: DataFrame, size: int = WORDS) -> dict[str, int]:
    """The most frequent words of all texts, by falling count, ties by the word; at most `size`."""
    return {w: i for i, (w, _) in enumerate(most_frequent(word_counts(docs), size))}


def tail_of(counts: DataFrame, last: tuple[str, int] | None, most: int = TAIL) -> tuple[np.ndarray, np.ndarray]:
    """log P(word | class) by bucket, and the classes' counts, of the words behind `last`, the last one of the vocabulary."""
    buckets = min(most, max(HASHED, 1 << (2 * counts.count()).bit_length()))
    rest = counts.where((F.col("n") < last[1]) | ((F.col("n") == last[1]) & (F.col("word") > last[0]))) if last else counts
    sized = rest.groupBy((F.crc32(F.col("word").cast("binary")) % buckets).alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    width = -(-buckets // SLICES)

    def dense(rows: pd.DataFrame) -> pd.DataFrame:
        out, part = np.zeros((2, width), np.float32), int(rows["slice"].iloc[0])
        out[:, rows["bucket"].to_numpy() - part * width] = rows["n"], rows["types"]
        return pd.DataFrame({"slice": [part], "vector": [out.tobytes()]})

    cut = sized.withColumn("slice", F.floor(F.col("bucket") / width).cast("int"))
    n, types = np.zeros((2, SLICES * width))
    for row in cut.groupBy("slice").applyInPandas(dense, "slice int, vector binary").collect():
        at = slice(row["slice"] * width, (row["slice"] + 1) * width)
        n[at], types[at] = np.frombuffer(bytes(row["vector"]), np.float32).reshape(2, width)
    n, types = n[:buckets] + UNSEEN, types[:buckets] + UNSEEN
    own = np.arange(buckets) % HASHED
    total = np.bincount(own, n)
    return np.log(n / types / np.maximum(total, 1)[own]).astype(np.float32), total


class Tree:
    """A Huffman tree: for each class the nodes from the root down, and at each whether the way goes right."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        order = np.argsort(counts, kind="stable")
        leaves, made = deque(zip(counts[order].tolist(), order.tolist())), deque()
        parent, right = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, bool)
        for node in range(n, 2 * n - 1):  # of two queues in order, the two lightest meet
            pair = [(made if not leaves or (made and made[0][0] < leaves[0][0]) else leaves).popleft() for _ in range(2)]
            parent[[p[1] for p in pair]], right[pair[1][1]] = node, True
            made.append((pair[0][0] + pair[1][0], node))
        at, depth = np.arange(n), np.zeros(n, np.int64)
        while (up := parent[at] >= 0).any():
            depth += up
            at = np.where(up, parent[at], at)
        self.sizes, self.starts = depth, np.cumsum(depth) - depth
        self.nodes, self.right = np.zeros(int(depth.sum()), np.uint16), np.zeros(int(depth.sum()), bool)
        at, left = np.arange(n), depth.copy()
        while (up := left > 0).any():
            own = np.flatnonzero(up)
            left[own] -= 1
            self.nodes[self.starts[own] + left[own]], self.right[self.starts[own] + left[own]] = parent[at[own]] - n, right[at[own]]
            at[own] = parent[at[own]]

        # a node is heavier than those below it, so the heavy ones are the first of every way
        self.heavy = max(0, n - 1 - HEAVY)
        self.width = n - 1 - self.heavy
        self.decisions = self.nodes * np.int32(2) + self.right
        owner = np.repeat(np.arange(n), depth)
        tops = np.bincount(owner, self.nodes >= self.heavy, n).astype(np.int64)
        self.rests, self.rest_starts = (depth - tops).astype(np.uint16), self.starts + tops
        # words that leave the heavy nodes alike share a row of places and signs, filled up by a decision of no account
        last = self.rest_starts - 1
        _, which, self.exits = np.unique(self.decisions[last], return_index=True, return_inverse=True)
        column = np.arange(tops[which].max())[:, None]
        there, place = column < tops[which], np.minimum(self.starts[which] + column, last[which])
        self.paths = np.where(there, self.nodes[place].astype(np.int64) - self.heavy, self.width)
        self.path_signs = np.where(there & ~self.right[place], np.float32(-1), np.float32(1))

    def ways(self, codes: np.ndarray) -> Ways:
        return Ways(self, codes)


class Ways:
    """Every decision on the ways to some words: whose it is, its node, and its sign, 1 where the way goes right.

    The HEAVY last nodes, with which every way starts, are worked out for all words by one matrix product. The rest go step by
    step: `order` puts words with many of them first, so that those which have a step are the first `reach` ones, and rows
    of a step's decisions and of its words lie alike.
    """

    def __init__(self, tree: Tree, codes: np.ndarray):
        rests = np.take(tree.rests, codes)
        self.order = np.argsort(np.uint16(0xFFFF) - rests, kind="stable")
        codes, self.heavy, self.width = np.take(codes, self.order), tree.heavy, tree.width
        exits = np.take(tree.exits, codes)
        self.top_sign = np.take(tree.path_signs, exits, axis=1)
        self.top_at = np.take(tree.paths, exits, axis=1)  # in a table of words and heavy nodes, and a column of no account
        self.top_at += np.arange(0, len(codes) * (tree.width + 1), tree.width + 1)
        reach = (len(codes) - np.cumsum(np.bincount(rests)))[:-1].tolist()
        ends = list(accumulate(reach, initial=0))
        self.steps = list(zip(reach, ends, ends[1:]))
        self.owner, place = np.empty(ends[-1], np.int64), np.empty(ends[-1], np.int64)
        starts, words = np.take(tree.rest_starts, codes), np.arange(len(codes))
        for k, (n, a, b) in enumerate(self.steps):
            self.owner[a:b] = words[:n]
            np.add(starts[:n], k, out=place[a:b])
        decisions = np.take(tree.decisions, place)
        self.node, self.sign = (decisions >> 1).astype(np.uint16), ((decisions & 1) * 2 - 1).astype(np.float32)

    def scores(self, nodes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the decisions at heavy nodes and at others are made by, and weights of the others; h: in `order`."""
        wide = np.empty((len(h), self.width + 1), h.dtype)
        np.matmul(h, nodes[self.heavy :].T, out=wide[:, :-1])
        wide[:, -1] = 60  # a chance of 1
        weights = np.take(nodes, self.node, axis=0)
        products = np.empty_like(weights)
        for n, a, b in self.steps:
            np.multiply(weights[a:b], h[:n], out=products[a:b])
        return np.take(wide, self.top_at), products @ np.ones(WIDTH, h.dtype), weights


def chance(z: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """P of decisions."""
    return 1 / (1 + np.exp(np.minimum(-z * sign, 60)))


@dataclass
class Model:
    """words: their codes; tail: log P(word | class) by bucket, none if the words of a class are one.

    params: rows of WIDTH: an embedding for each class and the padding, the tree's nodes, a weight for each place, and a bias.
    """

    words: dict[str, int]
    tree: Tree
    params: np.ndarray
    tail: np.ndarray | None = None
    classes: int = field(init=False)

    def __post_init__(self):
        self.classes = len(self.tree.sizes)


class Coder:
    """word -> class; words outside the vocabulary by a hash: `base` and more, up to `base` + `buckets`."""

    def __init__(self, words: dict[str, int], base: int | None = None, buckets: int = HASHED):
        self.words, self.base, self.buckets = words, len(words) if base is None else base, buckets

    def code(self, words: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self.words.get, words, repeat(-1)), np.int32, len(words))
        unknown = np.flatnonzero(codes < 0)
        codes[unknown] = [self.base + crc32(words[i].encode("utf-8", "surrogatepass")) % self.buckets for i in unknown.tolist()]
        return codes

    def pack(self, text: str | None) -> tuple[int, bytes, bytes]:
        """A text's words: how many, the class of each in 16 bits, and the buckets of those outside the vocabulary in 32."""
        codes = self.code(split_words(text))
        rare = codes >= self.base
        buckets = codes[rare] - self.base
        codes[rare] = len(self.words) + buckets % HASHED
        return len(codes), codes.astype(np.uint16).tobytes(), buckets.tobytes()


def coder_of(model: Model) -> Coder:
    return Coder(model.words, model.classes, HASHED if model.tail is None else len(model.tail))


def coded(docs: DataFrame, model: Model) -> tuple[DataFrame, str, str]:
    """`docs` with their words as `Coder.pack` has them in place of their texts; the names of that column and of the lot that decides on a round."""
    shared = docs.sparkSession.sparkContext.broadcast(coder_of(model))
    own, lot = unused(docs, "_lm"), unused(docs, "_lot")

    @F.pandas_udf("n_words long, classes binary, rare binary")
    def pack(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([shared.value.pack(t) for t in texts], columns=["n_words", "classes", "rare"])

    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(LOTS)).cast("int")
    return docs.select(*without(docs, "text"), drawn.alias(lot), pack(F.col("text")).alias(own)), own, lot


def rows_of(classes: int) -> dict[str, slice]:
    """Where the parameters' parts are; the padding's embedding stands behind the classes'."""
    sizes = {"embeddings": classes + 1, "nodes": classes - 1, "places": len(PLACES), "bias": 1}
    ends = np.cumsum(list(sizes.values())).tolist()
    return {name: slice(end - size, end) for (name, size), end in zip(sizes.items(), ends)}


def initial(classes: int, seed: int = 0) -> np.ndarray:
    at = rows_of(classes)
    out = np.zeros((at["bias"].stop, WIDTH), np.float32)
    out[at["embeddings"]] = np.random.default_rng(seed).standard_normal((classes + 1, WIDTH)) * 0.1
    out[at["places"]] = 1.0
    return out


def neighbours_of(codes: np.ndarray, pad: int) -> np.ndarray:
    """(places, words): the classes around every word."""
    padded = np.concatenate([np.full(SIDE, pad, np.int32), codes, np.full(SIDE, pad, np.int32)])
    return np.stack([padded[SIDE + p : SIDE + p + len(codes)] for p in PLACES])


def lined(each: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one behind the other, SIDE paddings before, between and behind them; and where the words stand in this line."""
    gap, sizes = np.full(SIDE, pad, np.uint16), np.array([len(c) for c in each], np.int64)
    line = np.concatenate([gap, *(x for c in each for x in (c, gap))])
    return line, np.arange(sizes.sum()) + SIDE * np.repeat(np.arange(1, len(each) + 1), sizes)


def apart(codes: np.ndarray, neighbours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A line in which every word stands between its own neighbours."""
    line = np.insert(neighbours, SIDE, codes, axis=0).T.ravel()
    return line, np.arange(SIDE, len(line), 2 * SIDE + 1)


def window(line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of a line that the words `at` and their sides take, and where they are in it."""
    start = int(at[0]) - SIDE
    return line[start : int(at[-1]) + SIDE + 1], at - start


def beside(rows: np.ndarray) -> list[np.ndarray]:
    """For each place the rows of a line that stand there, beside all rows but SIDE at both ends."""
    return [rows[SIDE + p : len(rows) - SIDE + p] for p in PLACES]


def hidden(params: np.ndarray, at: dict[str, slice], embedded: np.ndarray) -> np.ndarray:
    """The layer's outputs along a line, the last of which is 1, so that a node's last weight is its bias."""
    total = embedded[: len(embedded) - 2 * SIDE] * params[at["places"]][0]
    for weight, own in zip(params[at["places"]][1:], beside(embedded)[1:]):
        total += own * weight
    total += params[at["bias"]]
    np.tanh(total, out=total)
    total[:, -1] = 1
    return total


def log_probabilities(model: Model, codes: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """log P(word | both sides) of every word."""
    return line_log_probabilities(model, *apart(codes, neighbours))


def line_log_probabilities(model: Model, line: np.ndarray, words: np.ndarray) -> np.ndarray:
    """log P(word | both sides) of the words that stand at `words` in a line."""
    if not len(words):
        return np.zeros(0, np.float32)
    at = rows_of(model.classes)
    ways = model.tree.ways(line[words])
    h = np.take(hidden(model.params, at, np.take(model.params, line, axis=0)), words[ways.order] - SIDE, axis=0)
    top, rest, _ = ways.scores(model.params[at["nodes"]], h)
    p = np.multiply.reduce(chance(top, ways.top_sign), axis=0, dtype=float)
    rest = chance(rest, ways.sign)
    for n, a, b in ways.steps:
        p[:n] *= rest[a:b]
    out = np.empty_like(p)
    out[ways.order] = np.log(np.maximum(p, TINY))
    return out


def summed(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that start at `first`; two numbers are added at once, as the parts of a complex one."""
    return np.add.reduceat(rows.view(np.result_type(rows, np.complex64)), first).view(rows.dtype)


def aligned(rows: np.ndarray, line: int = 64) -> np.ndarray:
    """A copy whose rows of WIDTH numbers lie in a line of the processor's cache each."""
    room = np.empty(rows.nbytes + line, np.uint8)
    start = -room.ctypes.data % line
    out = room[start : start + rows.nbytes].view(rows.dtype).reshape(rows.shape)
    out[:] = rows
    return out


def put(table: np.ndarray, rows: np.ndarray | slice, values: np.ndarray) -> None:
    """table[rows] = values; rows by number are moved as wholes."""
    if isinstance(rows, slice):
        table[rows] = values
    else:
        whole = np.dtype((np.void, table.shape[1] * table.itemsize))
        np.put(table.view(whole).ravel(), rows, np.ascontiguousarray(values, table.dtype).view(whole).ravel())


class Trainer:
    """AdaGrad on the rows that a window touches, `batch` windows at a time.

    predicted, beside: how often each class was predicted, and stood beside a word that was.
    """

    def __init__(self, model: Model, rate: float = 0.1, batch: int = 1024, masked: float = 1.0):
        self.tree, self.params, self.at = model.tree, aligned(model.params), rows_of(model.classes)
        self.seen = aligned(np.full(self.params.shape, 1e-3, np.float32))
        self.predicted, self.beside = np.zeros((2, model.classes + 1))
        self.rate, self.batch, self.windows = rate, batch, 0
        self.masked, self.random = masked, np.random.default_rng(1)

    def learn(self, codes: np.ndarray, neighbours: np.ndarray) -> None:
        self.learn_line(*apart(codes, neighbours))

    def learn_line(self, line: np.ndarray, words: np.ndarray) -> None:
        if self.masked < 1:
            words = words[self.random.random(len(words)) < self.masked]
        here, times = np.zeros(len(line) - 2 * SIDE), np.zeros(len(line))
        here[words - SIDE] = 1
        for to in beside(times):
            to += here
        self.beside += np.bincount(line, times, len(self.beside))
        self.predicted += np.bincount(line[words], minlength=len(self.predicted))
        for k in range(0, len(words), self.batch):
            self.step_line(*window(line, words[k : k + self.batch]))

    def met(self) -> np.ndarray:
        """How often each row of the parameters was met."""
        out = np.zeros(len(self.params), np.float32)
        out[self.at["embeddings"]] = self.beside
        tree = self.tree
        out[self.at["nodes"]] = np.bincount(tree.nodes, np.repeat(self.predicted[:-1], tree.sizes), len(tree.sizes) - 1)
        out[self.at["places"]] = out[self.at["bias"]] = self.predicted.sum()
        return out

    def moved(self, rows: np.ndarray | slice, gradient: np.ndarray) -> None:
        """`rows` are not repeated."""
        whole = isinstance(rows, slice)
        seen = gradient * gradient
        seen += self.seen[rows] if whole else np.take(self.seen, rows, axis=0)
        put(self.seen, rows, seen)
        np.sqrt(seen, out=seen)
        np.divide(gradient, seen, out=seen)
        seen *= -self.rate
        seen += self.params[rows] if whole else np.take(self.params, rows, axis=0)
        put(self.params, rows, seen)

    def by_row(self, rows: np.ndarray, source: np.ndarray, at: np.ndarray | None = None, weights: np.ndarray | None = None, offset: int = 0) -> None:
        """Adds up the gradients of equal rows, numbered in 16 bits, and moves these; gradients: those of `source`, or its rows `at` times `weights`."""
        order = np.argsort(rows, kind="stable")
        own = np.take(rows, order)
        first = np.concatenate([ZERO, np.flatnonzero(own[1:] != own[:-1]) + 1])
        runs = np.empty_like(first)
        np.subtract(first[1:], first[:-1], out=runs[:-1])
        runs[-1] = len(own) - first[-1]
        short = np.minimum(runs, SHORT + 1).astype(np.uint8)
        falling = np.argsort(SHORT + 1 - short, kind="stable")
        first, longer = np.take(first, falling), len(runs) - np.cumsum(np.bincount(short, minlength=SHORT + 2))
        if at is not None:
            at, weights = np.take(at, order), np.take(weights, order)[:, None]

        def gradients(which: np.ndarray) -> np.ndarray:
            if at is None:
                return np.take(source, np.take(order, which), axis=0)
            found = np.take(source, np.take(at, which), axis=0)
            found *= np.take(weights, which, axis=0)
            return found

        # the first entries of all runs, then the second ones where there are any; long runs at once
        total, many = gradients(first), longer[SHORT]
        for k in range(1, SHORT):
            if longer[k] > many:
                total[many : longer[k]] += gradients(first[many : longer[k]] + k)
        if many:
            sizes = np.take(runs, falling[:many])
            ends = np.cumsum(sizes)
            total[:many] = summed(gradients(np.arange(ends[-1]) + np.repeat(first[:many] - ends + sizes, sizes)), ends - sizes)
        self.moved(np.take(own, first).astype(np.int64) + offset, total)

    def step(self, codes: np.ndarray, neighbours: np.ndarray) -> None:
        self.step_line(*apart(codes, neighbours))

    def step_line(self, line: np.ndarray, words: np.ndarray) -> None:
        at, n = self.at, len(words)
        self.windows += n
        ways, nodes = self.tree.ways(line[words]), self.params[at["nodes"]]
        embedded, spots = np.take(self.params, line, axis=0), words[ways.order] - SIDE
        h = np.take(hidden(self.params, at, embedded), spots, axis=0)
        top, rest, weights = ways.scores(nodes, h)
        wide = np.zeros((n, self.tree.width + 1), h.dtype)
        np.put(wide, ways.top_at, (chance(top, ways.top_sign) - 1) * ways.top_sign)
        wide = wide[:, :-1]
        error = (chance(rest, ways.sign) - 1) * ways.sign
        back = wide @ nodes[ways.heavy :]
        weights *= error[:, None]
        for m, a, b in ways.steps:
            back[:m] += weights[a:b]
        back *= 1 - h * h  # nothing at the last output, which is 1
        scale = self.params[at["places"]].copy()

        # along the line, what a place's neighbour is asked to change is added up before rows are looked for
        spread, asked = np.zeros((len(line) - 2 * SIDE, WIDTH), back.dtype), np.zeros((len(line), WIDTH), back.dtype)
        put(spread, spots, back)
        for weight, to in zip(scale, beside(asked)):
            to += spread * weight
        ones = np.ones(len(spread), spread.dtype)
        places = [ones @ (spread * own) for own in beside(embedded)]
        if len(ways.node):
            self.by_row(ways.node, h, ways.owner, error, at["nodes"].start)
        self.by_row(line.astype(np.uint16), asked)
        # heavy nodes, places and bias are the last rows
        self.moved(slice(at["nodes"].start + ways.heavy, at["bias"].stop), np.vstack([wide.T @ h, *places, ones @ spread]))


def averaged(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's rows averaged over partitions, weighted by how often each was met, which is the last column."""
    total = np.zeros(1)
    for vector in rows.sort_values("part")["vector"]:
        own = np.frombuffer(vector, np.float32).reshape(-1, WIDTH + 1).astype(float)
        total = total + np.column_stack([own[:, :-1] * own[:, -1:], own[:, -1:]])
    total[:, :-1] /= np.maximum(total[:, -1:], 1)
    return pd.DataFrame({"block": rows["block"].iloc[:1], "lot": 0, "part": rows["part"].min(), "vector": [total.astype(np.float32).tobytes()]})


def untrained(docs: DataFrame, size: int = WORDS) -> tuple[Model, float]:
    """A network that has learned nothing but the counts of all words, and how many these are together."""
    counts = cut_lineage(word_counts(docs))
    listed = most_frequent(counts, size)
    tail, rest = tail_of(counts, listed[-1] if listed else None)
    tree = Tree(np.concatenate([[n for _, n in listed], rest]))
    total = sum(n for _, n in listed) + float(rest.sum())
    return Model({w: i for i, (w, _) in enumerate(listed)}, tree, initial(len(listed) + HASHED), tail), total


def train(docs: DataFrame, rounds: int = 2, share: float | None = None, blocks: int = 16, size: int = WORDS, masked: float = MASKED) -> Model:
    """A network trained on `share` of all documents in each of `rounds` rounds; by default the rounds cover all."""
    model, total = untrained(docs, size)
    return taught(model, total, *coded(docs, model), rounds, share, blocks, masked)


def taught(model: Model, total: float, docs: DataFrame, own: str, lot: str, rounds: int = 2, share: float | None = None, blocks: int = 16, masked: float = MASKED) -> Model:
    """`model` trained on coded documents of `total` words together."""
    edges = [round(r * (1 / rounds if share is None else share) * LOTS) for r in range(rounds + 1)]
    tasks = max(1, round(total * (edges[1] - edges[0]) / LOTS / LEAST))
    context = docs.sparkSession.sparkContext
    cuts = np.linspace(0, len(model.params), blocks + 1).astype(int).tolist()
    schema = "block int, lot int, part int, vector binary"
    for r in range(rounds):
        shared = context.broadcast(Model({}, model.tree, model.params))
        chosen = docs.where((F.col(lot) >= edges[r]) & (F.col(lot) < edges[r + 1])).select(f"{own}.classes").coalesce(tasks)
        lots = max(1, round(min(tasks, chosen.rdd.getNumPartitions()) ** 0.5))

        def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trainer, pad = Trainer(shared.value, masked=masked), shared.value.classes
            for part in parts:
                for packed in batches(part["classes"], 130_000):
                    each = [np.frombuffer(c, np.uint16) for c in packed if len(c)]
                    if each:
                        trainer.learn_line(*lined(each, pad))
            if trainer.windows:
                told = np.column_stack([trainer.params, trainer.met()])
                number = TaskContext.get().partitionId()
                yield pd.DataFrame({"block": range(blocks), "lot": number % lots, "part": number, "vector": [told[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]})

        trained = chosen.mapInPandas(learn, schema).groupBy("block", "lot").applyInPandas(averaged, schema).groupBy("block").applyInPandas(averaged, schema)
        params = model.params.copy()
        for row in trained.collect():
            told = np.frombuffer(bytes(row["vector"]), np.float32).reshape(-1, WIDTH + 1)
            met = told[:, -1] > 0
            params[cuts[row["block"]] : cuts[row["block"] + 1]][met] = told[met, :-1]
        model = Model(model.words, model.tree, params, model.tail)
    return model


class Scorer:
    def __init__(self, model: Model, known: int | None = None):
        """known: how many words the vocabulary has, where the model comes without them."""
        self.known = len(model.words) if known is None else known
        self.tail = np.zeros(HASHED, np.float32) if model.tail is None else model.tail
        self.model, self.coder = Model(model.words, model.tree, aligned(model.params)), coder_of(model)

    def documents(self, texts: pd.Series, piece: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """Words and summed log-probabilities of the texts."""
        packed = [self.coder.pack(t) for t in texts]
        return np.array([n for n, _, _ in packed], np.int64), self.packed([c for _, c, _ in packed], [r for _, _, r in packed], piece)

    def packed(self, classes: Iterable[bytes], rare: Iterable[bytes], piece: int = STEP) -> np.ndarray:
        """Summed log-probabilities of the texts whose words are packed so."""
        each = [np.frombuffer(c, np.uint16) for c in classes]
        line, words = lined(each, self.model.classes)
        done = [line_log_probabilities(self.model, *window(line, words[a : a + piece])) for a in range(0, len(words), piece)]
        logs = np.concatenate([*done, np.zeros(0, np.float32)]).astype(float)
        logs[line[words] >= self.known] += self.tail[np.frombuffer(b"".join(rare), np.int32)]
        return sums(logs, np.array([len(c) for c in each], np.int64))


def scored(docs: DataFrame) -> DataFrame:
    """`docs` without their texts, with n_words, log_likelihood and mean_log_probability by a network trained on all of them.

    As `score(docs, train(docs))`, but words are looked up once: their classes are written to the shared folder and read by training and scoring.
    """
    model, total = untrained(docs)
    found, own, lot = coded(docs, model)
    found = cut_lineage(found)
    model = taught(model, total, found, own, lot)
    # words are looked up already
    shared = docs.sparkSession.sparkContext.broadcast((len(model.words), Model({}, model.tree, model.params, model.tail)))

    @F.pandas_udf("double")
    def likelihood(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value[1], shared.value[0])
        for classes, rare in parts:
            done = [scorer.packed(part, rare[part.index]) for part in batches(classes, 400_000)]
            yield pd.Series(np.concatenate(done or [[]]), dtype=float)

    total = unused(found, "_total")
    found = found.withColumn(total, likelihood(f"{own}.classes", f"{own}.rare"))
    return _told(found, F.col(f"{own}.n_words"), F.col(total), own, lot, total)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with n_words, log_likelihood (summed) and mean_log_probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_words long, log_likelihood double")
    def likelihood(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in parts:
            done = [scorer.documents(part) for part in batches(texts.fillna(""), 1_000_000)]
            yield pd.DataFrame({"n_words": np.concatenate([d[0] for d in done] or [[]]), "log_likelihood": np.concatenate([d[1] for d in done] or [[]])})

    own = unused(docs, "_lm")
    found = docs.withColumn(own, likelihood(F.col("text")))
    return _told(found, F.col(f"{own}.n_words"), F.col(f"{own}.log_likelihood"), own)


def _told(found: DataFrame, n: Column, total: Column, *working: str) -> DataFrame:
    """`found` without the columns that were only worked with, with those of the result."""
    names = ("n_words", "log_likelihood", "mean_log_probability")
    return found.select(*without(found, *names, *working), n.alias(names[0]), total.alias(names[1]), F.try_divide(total, n).alias(names[2]))
