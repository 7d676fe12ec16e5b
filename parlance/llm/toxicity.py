"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the probability p_s = sigmoid(b + sum of the weights
of its distinct words), where a word's weight is the sum over its hashed features (the word and its
character n-grams). Sentences are combined by noisy-or, P = 1 - prod(1 - p_s), which is trained from
document labels alone by follow-the-regularised-leader (per-coordinate rates, L1) in numpy. The trained
sentence scores then say which sentences offend.

Training takes at most `per_class` labelled documents of each class (a bounded, documented sample;
whole texts) to one task of an executor; the driver gets the model. Classes are weighted back to
their shares among all labels. Features that fewer than `rare` of the sample's documents have (and those of
one document) are not learned, as they would only recall single documents; a document with no other features
teaches nothing, not even the bias, which toxic ones would raise without telling what offends.

Defined results: a null or empty text has no sentence and gets the score of a bag with one empty
sentence. Long texts are scored whole, sentence after sentence. Input columns called like an output
are replaced. With no labels of one class the score is that class's constant share (0.5 without
labels). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import Lexicon, Subwords, batches, class_weights, fit_in_task, labelled_sample, sigmoid, sums, without

#: A sentence ends at . ! ? or a line end; words are what ASCII white space and punctuation leave.
ENDS = ".!?\n\r"
SPLIT = str.maketrans({c: "\n" for c in ENDS} | {chr(c): " " for c in range(128) if not chr(c).isalnum() and chr(c) not in ENDS})
BUCKETS, LOW, HIGH = 1 << 18, 4, 6


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """(start, end, distinct words) of the sentences that have words, in code points."""
    out, start = [], 0
    for sentence in (text or "").translate(SPLIT).split("\n"):
        words = list(set(sentence.lower().split()))
        if words:
            out.append((start, start + len(sentence), words))
        start += len(sentence) + 1
    return out


def bag(text: str | None, subwords: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all sentences, one after the other, and where each sentence begins."""
    found = sentences(text)
    words = [w for _, _, own in found for w in own]
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    owner, ids = subwords(words)
    sentence = np.repeat(np.arange(len(found)), [len(own) for _, _, own in found])[owner]
    order = np.argsort(sentence, kind="stable")
    counts = np.bincount(sentence, minlength=len(found))
    return ids[order].astype(np.int32), np.cumsum(counts) - counts


def without_rare(bags: list[tuple[np.ndarray, np.ndarray]], rare: float) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(ids, starts, blank): the bags without rare features; `blank` sentences have none left."""
    has = np.zeros(BUCKETS, np.int64)
    for ids, _ in bags:
        has[np.unique(ids)] += 1
    common = has >= max(2.0, rare * len(bags))
    out = []
    for ids, starts in bags:
        sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
        kept = common[ids]
        counts = np.bincount(sentence[kept], minlength=len(starts))
        out.append((ids[kept], (np.cumsum(counts) - counts)[counts > 0], int((counts == 0).sum())))
    return out


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], y: np.ndarray, weight: np.ndarray, epochs: int = 10, alpha: float = 0.2, l1: float = 8.0, seed: int = 11) -> Model:
    """Follow-the-regularised-leader on the noisy-or likelihood, a document at a time.

    A feature has no weight until the gradients it gathered exceed `l1`, so what only one or two toxic
    documents say is not learned by heart.
    """
    lead, squares = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias, seen_bias = -4.0, 1e-2

    def now(ids: np.ndarray) -> np.ndarray:
        z = lead[ids]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) * alpha / (1.0 + np.sqrt(squares[ids])))

    # what does not change from epoch to epoch: distinct features, where they are, lengths of sentences
    fixed = [(*np.unique(ids, return_inverse=True), starts, np.diff(np.append(starts, len(ids))), blank) for ids, starts, blank in bags]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for d in order.permutation(len(bags)):
            distinct, at, starts, lengths, blank = fixed[d]
            if not len(distinct):
                continue
            w = now(distinct)
            z = np.add.reduceat(w[at], starts) + bias
            none_toxic = np.exp(-np.logaddexp(0.0, z).sum() - blank * np.logaddexp(0.0, bias))
            # d(-log likelihood)/dz: p for a clean document, -p (1 - P) / P for a toxic one
            slope = weight[d] * (1.0 if y[d] == 0 else -none_toxic / max(1.0 - none_toxic, 1e-9))
            g = sigmoid(z) * slope
            grad = np.bincount(at, np.repeat(g, lengths))
            more = squares[distinct] + grad * grad
            lead[distinct] += grad - (np.sqrt(more) - np.sqrt(squares[distinct])) / alpha * w
            squares[distinct] = more
            total = g.sum() + blank * sigmoid(bias) * slope
            seen_bias += total * total
            bias -= 0.2 * total / np.sqrt(seen_bias)
    return Model(now(np.arange(BUCKETS)).astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, folds: int = 5, rare: float = 0.002) -> Model:
    """A model from `labels.toxic`; rows of fold 0 (crc32 of the id modulo `folds`) take no part."""
    sample, totals = labelled_sample(docs, labels, "toxic", per_class, folds)
    if len(totals) < 2:
        p = float(next(iter(totals), 0.5))
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((p + 1e-6) / (1 - p + 1e-6))))

    def learn(rows: pd.DataFrame) -> Model:
        subwords = Subwords(LOW, HIGH, BUCKETS)
        y = rows["y"].to_numpy()
        return fit(without_rare([bag(t, subwords) for t in rows["text"]], rare), y, class_weights(y, totals))

    return fit_in_task(sample, learn)


class Scorer:
    """Sentence logits of texts, with the scores of words kept from text to text."""

    def __init__(self, model: Model):
        self.model, self.subwords = model, Subwords(LOW, HIGH, BUCKETS)
        self.words = Lexicon(self._rows)

    def _rows(self, words: list[str]) -> np.ndarray:
        owner, ids = self.subwords(words)
        return np.bincount(owner, self.model.weights[ids], minlength=len(words))

    def logits(self, bags: list[list[str]]) -> np.ndarray:
        return self.model.bias + sums(self.words([w for own in bags for w in own]), [len(own) for own in bags])

    def documents(self, texts: pd.Series) -> np.ndarray:
        bags, sizes = [], []
        for text in texts:
            own = [words for s in (text or "").lower().translate(SPLIT).split("\n") if (words := set(s.split()))] or [()]
            bags += own
            sizes.append(len(own))
        return -np.expm1(-sums(np.logaddexp(0.0, self.logits(bags)), sizes))


def probability(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function of a text's column: the probability that it is toxic."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def toxicity(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in parts:
            out = np.concatenate([scorer.documents(part) for part in batches(texts.fillna(""))]) if len(texts) else []
            yield pd.Series(out, dtype="float64")

    return toxicity


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """`docs` with the probability that its text is toxic."""
    return docs.select(*without(docs, column), probability(docs.sparkSession, model)(F.col("text")).alias(column))


def locate(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score): the sentences that offend, in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def spans(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"]):
                own = sentences(text)
                p = sigmoid(scorer.logits([words for _, _, words in own])) if own else []
                rows += [(doc_id, start, end, float(x)) for (start, end, _), x in zip(own, p) if x >= threshold]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "score"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(spans, "doc_id long, start long, end long, score double")
