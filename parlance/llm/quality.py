"""Document quality by supervised subword embeddings.

Every word and every character n-gram of <word> has a hashed, learned vector. A document is the
average of the vectors of all its features; a softmax layer on it gives the class. Vectors and layer
are trained together by stochastic gradient descent in numpy. As the layer is linear, scoring needs
one number per feature (its vector's part of the logit), kept per word.

Training takes at most `per_class` labelled documents of each class (a bounded, documented sample;
whole texts) to one task of an executor; the driver gets the model. Classes are weighted back to
their shares among all labels.

Defined results: a null or empty text has no feature and gets the class shares' score. Long texts
are averaged whole. Input columns called like an output are replaced. With labels of one class only
the score is that class's constant share (0.5 without labels). An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import Lexicon, Subwords, batches, class_weights, fit_in_task, labelled_sample, sigmoid, sums, without

BUCKETS, LOW, HIGH, WIDTH = 1 << 18, 3, 5, 8
AGAIN = "\x00"


@dataclass
class Model:
    features: np.ndarray  # each bucket's part of log P(1) - log P(0)
    bias: float


def tokens(text: str | None) -> list[str]:
    """Words between white space; a word equal to the one before it counts as the sign AGAIN."""
    words = (text or "").split()
    return words[:1] + [AGAIN if w == before else w for before, w in zip(words, words[1:])]


def counted(text: str | None, subwords: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids of a text, and how often each occurs."""
    often = Counter(tokens(text))
    if not often:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    owner, ids = subwords(list(often))
    distinct, at = np.unique(ids, return_inverse=True)
    return distinct.astype(np.int32), np.bincount(at, np.array(list(often.values()))[owner]).astype(np.int32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = 6, rate: float = 5.0, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document at a time, on vectors and softmax layer."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    steps = epochs * len(bags)
    step = 0
    for _ in range(epochs):
        for d in random.permutation(len(bags)):
            now = rate * (1 - step / steps)
            step += 1
            ids, often = bags[d]
            share = (often / max(1, often.sum())).astype(np.float32)
            own = vectors[ids]
            hidden = share @ own
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[d]] -= 1.0
            g = p * np.float32(weight[d] * now)
            back = layer @ g
            layer -= np.outer(hidden, g)
            bias -= 0.1 * g
            # a feature's share of the average is tiny; its step is scaled by the distinct features
            vectors[ids] = own - np.outer(share * np.float32(min(len(ids), 400)), back) * np.float32(0.05)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, folds: int = 5) -> Model:
    """A model from `labels.quality`; rows of fold 0 (crc32 of the id modulo `folds`) take no part."""
    sample, totals = labelled_sample(docs, labels, "quality", per_class, folds)
    if len(totals) < 2:
        p = float(next(iter(totals), 0.5))
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((p + 1e-6) / (1 - p + 1e-6))))

    def learn(rows: pd.DataFrame) -> Model:
        subwords = Subwords(LOW, HIGH, BUCKETS)
        y = rows["y"].to_numpy()
        return fit([counted(t, subwords) for t in rows["text"]], y, class_weights(y, totals))

    return fit_in_task(sample, learn)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.subwords = model, Subwords(LOW, HIGH, BUCKETS)
        self.words = Lexicon(self._rows)

    def _rows(self, words: list[str]) -> np.ndarray:
        owner, ids = self.subwords(words)
        size = len(words)
        return np.stack([np.bincount(owner, self.model.features[ids], minlength=size), np.bincount(owner, minlength=size)], axis=1)

    def documents(self, texts: pd.Series) -> np.ndarray:
        split = [tokens(t) for t in texts]
        total = sums(self.words([w for words in split for w in words]), [len(words) for words in split])
        return sigmoid(self.model.bias + total[:, 0] / np.maximum(total[:, 1], 1))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """`docs` with the probability that its text is of quality class 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def quality(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in parts:
            out = np.concatenate([scorer.documents(part) for part in batches(texts.fillna(""))]) if len(texts) else []
            yield pd.Series(out, dtype="float64")

    return docs.select(*without(docs, column), quality(F.col("text")).alias(column))
