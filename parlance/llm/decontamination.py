"""Benchmark decontamination: CGK embeddings, bit-sampling LSH and exact edit verification.

Texts become word sequences (lower-cased; ASCII punctuation and white space part words). The CGK random
walk reads a sequence from some start: at step j it puts out the word under the pointer, and moves on or
stays by a random bit of (j, word). Sequences a few edits apart put out strings that differ in few places,
so edit distance becomes Hamming distance. From words of a document walks start and cover windows. An item of n
words and a stretch at most k edits from it share a run of at least (n - k) / (k + 1) words unchanged, so a walk
starts from every word within an item's reach of such a run (of at most RUN words), and words that no item can be
near are passed over without a loss.

Sampled steps of the walk, hashed together, are the keys of bit-sampling LSH. Keys of a walk reach over windows
of 4, 12 and 24 steps; those of the first walk go on over doubled windows to twice the longest item's words, so
that every item is covered by windows up to its own size (a walk of 2n steps passes about n words; LONGEST steps
at most, as longer items have many anchors). Items are walked likewise from anchors over their whole length
(each word of items below 24 words, then every twelfth part of the item, at most `STRIDE` words apart, and near
the end), so that edits near one anchor leave others. A key that an item and a window share makes a candidate.
Walks are repeated until `target` of trial copies of the benchmark's own items, edited at random to the very
limit of the budget, are found (MOST_WALKS at most; fewer found by these is an error). Each candidate is verified by the exact edit distance (in
words, bit-parallel) between the item and the best-fitting stretch of text around the candidate.

A document holds an item if the distance is at most (1 - `similarity`) x the item's words. Items of fewer
than SHORT words have no edit to spare; their runs of words are looked up by hash, without any walk. Items without
a word match nothing.

Documents are read once and never shuffled; benchmark items, the smaller side, are broadcast in blocks of
at most `block` items and BYTES characters (each is cut to its vocabulary, keys and word ids), with one pass per
block, so a broadcast stays bounded whatever the size of the benchmark.

Defined results: null or empty texts hold nothing; an empty benchmark gives an empty result; null ids are
kept as they are; repeated rows give repeated results. Of equally near stretches the first counts. Long texts are
read whole. Extra columns are left out of the matches and kept by drop_contaminated(), which decides row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import batches

STRIDE, TABLE, RUN, SHORT = 12, 1 << 22, 4, 5
FAR, LONGEST, BYTES = 24, 128, 40_000_000
WALKS, MOST_WALKS = 3, 8
#: Lower-cased text with ASCII punctuation and white space as blanks.
BLANK = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(BLANK).split()


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]  # of each item, as numbers from 1; 0 is any other word
    budgets: np.ndarray
    vocabulary: dict[bytes, int]
    moves: np.ndarray  # (walks, words, LONGEST / 64): bit j is the move at step j
    steps: list[list[list[int]]]  # of each walk: the sampled steps of each key
    far: int  # steps that the longest window has
    mixers: np.ndarray  # (walks, words): a random number for each word
    keys: np.ndarray  # sorted; which (item, anchor) have them is below
    owners: np.ndarray
    anchors: np.ndarray
    seen: np.ndarray  # bit table of the keys
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: sorted hashes, how far an item reaches, bit table
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # of items below SHORT words, by length: sorted hashes, items, bit table


def sample_steps(walks: int, samples: int, width: int, far: int, seed: int) -> list[list[list[int]]]:
    """Steps to sample, a part of each: the last two keys reach less far, for items that end before the others.

    The first walk has one more key for every doubling of the reach up to `far`.
    """
    random = np.random.default_rng(seed)
    out = []
    for v in range(walks):
        reaches = [{samples - 1: 4, samples - 2: 2 * width + 2}.get(s, FAR) for s in range(samples)]
        while v == 0 and max(reaches) < far:
            reaches.append(min(far, 2 * max(reaches)))
        own = []
        for reach in reaches:
            edges = np.linspace(0, reach, width + 1).astype(int)  # a step from each part, so that the words differ
            own.append([int(random.integers(a, max(b, a + 1))) for a, b in zip(edges, edges[1:])])
        out.append(own)
    return out


def move(moves: np.ndarray, words: np.ndarray, j: int) -> np.ndarray:
    return ((moves[words, j >> 6] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)


def prepare(ids: list, texts: list[str | None], similarity: float = 0.8, samples: int = 6, width: int = 5, target: float = 0.98, seed: int = 5) -> Items:
    """The items with as many walks as the target asks for; an error if the most walks don't reach it."""
    found = [(i, words) for i, words in ((i, words_of(t)) for i, t in zip(ids, texts)) if words]
    vocabulary: dict[bytes, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32) for _, words in found]
    budgets = np.array([int((1 - similarity) * len(own) + 1e-9) for own in coded], np.int64)
    far = min(LONGEST, max(FAR, 2 * max(map(len, coded), default=0)))
    for walks in range(WALKS, MOST_WALKS + 1):
        random = np.random.default_rng(seed)
        mixers = random.integers(0, 2**63, (walks, len(vocabulary) + 1), dtype=np.int64).view(np.uint64)
        moves = random.integers(0, 2**64, (walks, len(vocabulary) + 1, LONGEST // 64), dtype=np.uint64)
        steps = sample_steps(walks, samples, width, far, seed)
        keys, owners, anchors = item_keys(coded, moves, steps, mixers)
        items = Items([i for i, _ in found], coded, budgets, vocabulary, moves, steps, far, mixers, keys, owners, anchors, bit_table(keys), shared_runs(coded, budgets, mixers[0]), short_runs(coded, mixers[0]))
        recall = trial_recall(items)
        if recall >= target:
            return items
    raise ValueError(f"{MOST_WALKS} walks find {recall:.3f} of the items' edited copies, not {target}: raise MOST_WALKS or take fewer samples a key")


def edited(own: np.ndarray, budget: int, random: np.random.Generator) -> np.ndarray:
    """`own` with `budget` words replaced, left out or put in (0: a word of no item)."""
    out = own.tolist()
    for kind in random.integers(0, 3, budget):
        at = int(random.integers(0, len(out)))
        out[at : at + (kind != 2)] = [] if kind == 1 else [0]
    return np.array(out, np.int32)


def trial_recall(items: Items, most: int = 300, seed: int = 9) -> float:
    """The share of edited copies whose item becomes a candidate; of up to `most` items of all lengths, four copies each."""
    random = np.random.default_rng(seed)
    order = np.argsort([len(own) for own in items.words], kind="stable")
    drawn = order[np.linspace(0, len(order) - 1, min(most, len(order))).astype(int)] if len(order) else order
    copies = [(n, edited(items.words[n], int(items.budgets[n]), random)) for n in drawn.tolist() for _ in range(4)]
    gap = np.zeros(items.far, np.int32)
    texts = [x for _, copy in copies for x in (copy, gap)]
    ends = np.cumsum([len(copy) + items.far for _, copy in copies])
    doc, own, _ = candidates(np.concatenate([*texts, np.zeros(0, np.int32)]), ends, items)
    found = set(zip(doc.tolist(), own.tolist()))
    return sum((d, n) in found for d, (n, _) in enumerate(copies)) / len(copies) if copies else 1.0


def anchors_of(size: int) -> np.ndarray:
    """Places of an item where walks start: over its whole length, the last one at the last word but one."""
    return np.unique(np.append(np.arange(0, size - 1, min(STRIDE, max(1, size // 12))), size - 2))


def item_keys(coded: list[np.ndarray], moves: np.ndarray, steps: list[list[list[int]]], mixers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, owners, anchors), sorted by key: of the walks from all anchors, where all sampled steps are within the item."""
    places = [anchors_of(len(own)) if len(own) >= SHORT else np.zeros(0, np.int64) for own in coded]
    owner = np.repeat(np.arange(len(coded), dtype=np.int32), [len(a) for a in places])
    anchor = np.concatenate([*places, np.zeros(0, np.int64)])
    ends = np.cumsum([len(own) for own in coded], dtype=np.int64)
    words = np.concatenate([*coded, np.zeros(LONGEST + 1, np.int32)])
    begin = np.concatenate([np.zeros(1, np.int64), ends])[owner]
    keys, which = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for v, own in enumerate(steps):
        at, path = begin + anchor, []
        for j in range(max(map(max, own)) + 1):
            path.append(at)
            at = at + move(moves[v], words[at], j)
        for s, sampled in enumerate(own):
            inside = np.flatnonzero(path[max(sampled)] < ends[owner])
            keys.append(mix([mixers[v][words[path[j][inside]]] for j in sampled], v, s))
            which.append(inside)
    keys, which = np.concatenate(keys), np.concatenate(which)
    order = np.argsort(keys, kind="stable")
    return keys[order], owner[which[order]], anchor[which[order]].astype(np.int32)


def bit_table(keys: np.ndarray) -> np.ndarray:
    seen = np.zeros(TABLE, bool)
    seen[(keys >> np.uint64(42)).astype(np.int64)] = True
    return seen


def run_hashes(coded: np.ndarray, mixer: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes): of the runs of 1, 2, ... `most` words from each place that has as many words left."""
    mixed = mixer[coded]
    h = mixed * np.uint64(0xBF58476D1CE4E5B9)
    for length in range(1, most + 1):
        if length > 1:
            h = ((h[:-1] ^ (h[:-1] >> np.uint64(31))) + mixed[length - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        yield length, h


def shared_runs(coded: list[np.ndarray], budgets: np.ndarray, mixer: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of the items: an item's own length of run is what a stretch within its budget can't be without."""
    reach: dict[int, dict[int, int]] = {}
    for own, budget in zip(coded, budgets.tolist()):
        if len(own) < SHORT:
            continue
        needed = min(RUN, max(1, -(-(len(own) - budget) // (budget + 1))))
        *_, (_, hashes) = run_hashes(own, mixer, needed)
        known = reach.setdefault(needed, {})
        for h in hashes.tolist():
            known[h] = max(known.get(h, 0), len(own) + 2 * budget)
    out = {}
    for length, known in reach.items():
        hashes = np.array(sorted(known), np.uint64)
        out[length] = hashes, np.array([known[h] for h in hashes.tolist()], np.int64), bit_table(hashes)
    return out


def short_runs(coded: list[np.ndarray], mixer: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The whole of each item below SHORT words as one run."""
    out = {}
    for length in range(1, SHORT):
        own = np.array([n for n, words in enumerate(coded) if len(words) == length], np.int64)
        if len(own):
            *_, (_, hashes) = run_hashes(np.stack([coded[n] for n in own]).ravel(), mixer, length)
            hashes = hashes[::length][: len(own)]
            order = np.argsort(hashes, kind="stable")
            out[length] = hashes[order], own[order], bit_table(hashes)
    return out


def pairs(h: np.ndarray, keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in h, place in keys) of all equal values; `keys` is sorted, `seen` its bit table."""
    hit = np.flatnonzero(seen[(h >> np.uint64(42)).astype(np.int64)])
    low, high = np.searchsorted(keys, h[hit]), np.searchsorted(keys, h[hit], "right")
    n = high - low
    return np.repeat(hit, n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def within_reach(coded: np.ndarray, items: Items) -> np.ndarray:
    """Places of `coded` that a stretch near an item can hold: those within its reach of a shared run."""
    change = np.zeros(len(coded) + 1, np.int64)
    for length, h in run_hashes(coded, items.mixers[0], max(items.runs, default=0)):
        if length in items.runs:
            hashes, reach, seen = items.runs[length]
            hit = np.flatnonzero(seen[(h >> np.uint64(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(hashes, h[hit]), len(hashes) - 1)
            same = hashes[at] == h[hit]
            hit, far = hit[same], reach[at[same]]
            np.add.at(change, np.maximum(hit - far, 0), 1)
            np.add.at(change, np.minimum(hit + far, len(coded)), -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)


def mix(parts: list, v: int, s: int):
    """One number from the sampled words' numbers, in order."""
    with np.errstate(over="ignore"):
        h = np.uint64(1 + v * 64 + s)
        for p in parts:
            h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(32)) ^ (h << np.uint64(17))


def candidates(coded: np.ndarray, ends: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, position): windows of `coded` that share a key with an item, at the item's start.

    coded: documents one after the other, which end before `ends`, with `far` zeros after each.
    """
    padded = np.concatenate([coded, np.zeros(items.far + 1, coded.dtype)])
    found = [np.zeros((0, 3), np.int64)]

    def add(place: np.ndarray, start: np.ndarray, own: np.ndarray) -> None:
        found.append(np.stack([np.searchsorted(ends, place, "right"), own, start], axis=1))

    for length, h in run_hashes(coded, items.mixers[0], max(items.short, default=0)):
        if length in items.short:
            hashes, owners, seen = items.short[length]
            hit, k = pairs(h, hashes, seen)
            add(hit, hit, owners[k])
    starts = within_reach(coded, items)
    for v, own in enumerate(items.steps if len(starts) else ()):
        at = starts
        wanted = {j for sampled in own for j in sampled}
        path = {}
        for j in range(max(wanted) + 1):
            word = padded[at]
            if j in wanted:
                path[j] = items.mixers[v][word]
            at = at + move(items.moves[v], word, j)
        for s, sampled in enumerate(own):
            hit, k = pairs(mix([path[j] for j in sampled], v, s), items.keys, items.seen)
            add(starts[hit], starts[hit] - items.anchors[k], items.owners[k])
    unique = np.unique(np.concatenate(found), axis=0)
    return unique[:, 0], unique[:, 1], unique[:, 2]


def best_stretch(item: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, end): the least edit distance of `item` to a stretch of `text`, and where the first such ends.

    Bit-parallel dynamic programme over whole columns (Myers); an integer holds a column.
    """
    size = len(item)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, distance = full, 0, size
    best, end = size, 0
    for j, w in enumerate(text):
        match = where.get(w, 0)
        x = match | down
        d0 = (((x & up) + up) ^ up) | x
        add, less = down | (full & ~(d0 | up)), up & d0
        if add & top:
            distance += 1
        elif less & top:
            distance -= 1
        add, less = (add << 1) & full, (less << 1) & full
        up, down = less | (full & ~(d0 | add)), add & d0
        if distance < best:
            best, end = distance, j + 1
    return best, end


def matches(texts: list[str | None], items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(text's position, item's position, edit distance, word at which the stretch ends)."""
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    ends = np.cumsum(sizes + items.far)
    coded = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    get = items.vocabulary.get
    for words, end in zip(split, (ends - items.far).tolist()):
        coded[end - len(words) : end] = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
    doc, own, at = candidates(coded, ends, items)
    edges = np.flatnonzero(np.diff(doc, prepend=-1)).tolist()
    for low, high in zip(edges, [*edges[1:], len(doc)]):
        d = int(doc[low])
        end = int(ends[d]) - items.far
        start = end - int(sizes[d])
        for n, distance, stop in verified(coded[start:end], np.maximum(at[low:high] - start, 0), own[low:high], items):
            yield d, n, distance, stop


def verified(coded: np.ndarray, at: np.ndarray, own: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """The best verified match of each item among candidates sorted by item and place."""
    best: dict[int, tuple[int, int]] = {}
    last, reach = -1, -1
    for n, place in zip(own.tolist(), at.tolist()):
        item, budget = items.words[n], int(items.budgets[n])
        if n == last and place <= reach:
            continue  # the stretch compared last holds this window too
        if n in best and best[n][0] == 0:
            continue
        start = max(0, place - 2 * budget)
        stop = min(len(coded), place + len(item) + 4 * budget + 8)
        last, reach = n, place + 2 * budget + 8
        distance, end = best_stretch(item.tolist(), coded[start:stop].tolist())
        if distance <= budget and (n not in best or distance < best[n][0]):
            best[n] = (distance, start + end)
    for n, (distance, end) in sorted(best.items()):
        yield n, distance, end


def blocks_of(benchmark: DataFrame, similarity: float, block: int, **parameters: float) -> Iterator[Items]:
    """The prepared items, block after block."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters")).first()
    blocks = max(1, -(-size["n"] // block), -(-size["characters"] // BYTES))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toPandas().sort_values(["item_id", "text"], kind="stable")
        yield prepare([None if pd.isna(i) else int(i) for i in part["item_id"]], list(part["text"]), similarity, **parameters)


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block: int = 20_000, **parameters: float) -> DataFrame:
    """(doc_id, item_id, distance, similarity, end_word): each item that a document holds, at its best place."""
    found = None
    for items in blocks_of(benchmark, similarity, block, **parameters):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def search(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = shared.value
            for part in parts:
                rows = []
                for texts in batches(part["text"].fillna(""), 400_000):
                    for d, n, distance, end in matches(list(texts), own) if own.ids else ():
                        rows.append((part["doc_id"].at[texts.index[d]], own.ids[n], distance, 1 - distance / len(own.words[n]), end))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "similarity", "end_word"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        near = docs.select("doc_id", "text").mapInPandas(search, "doc_id long, item_id long, distance int, similarity double, end_word int")
        found = near if found is None else found.unionByName(near)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block: int = 20_000, **parameters: float) -> DataFrame:
    """`docs` without the documents that hold a benchmark item.

    Every row is decided where it is read, by its own text, so nothing is shuffled or joined, and rows without an
    id or with another row's id are told apart. A null text stays.
    """
    def clean(shared: Broadcast) -> Callable:
        @F.pandas_udf("boolean")
        def holds_none(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = shared.value
            for part in parts:
                fine = pd.Series(True, part.index)
                for texts in batches(part.fillna(""), 400_000):
                    held = [d for d, _, _, _ in matches(list(texts), own)] if own.ids else []
                    fine.loc[texts.index[held]] = False
                yield fine

        return holds_none

    out = docs
    for items in blocks_of(benchmark, similarity, block, **parameters):
        out = out.where(clean(docs.sparkSession.sparkContext.broadcast(items))(F.col("text")))
    return out
