"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the character n-grams of <word> for the words of a lower-cased text, hashed into BUCKETS. A
feature's value is its share of all the text's n-grams times log((1 + N) / (1 + df)) + 1, where N and df
count all documents of the training folds, whole texts. The regression is trained by
follow-the-regularised-leader (per-coordinate rates, L1 and L2), which leaves most weights exactly zero. A
fifth of the sample is kept from training, and on it a temperature is fitted that divides the logits.

The classifier is fitted on about `per_class` documents of each language, drawn by a hash of the id against
a threshold per language (a bounded, documented sample; of the rows of one id and language one, and no text of
more than `longest` characters); document frequencies cover all of them.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is every text where no
language could be learned. Long texts are read whole. Rows with a null id or lang are never learned from.
Input columns called like an output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import LONGEST, Lexicon, Subwords, batches, fit_in_task, remainder, sums, unused, without

BUCKETS, LOW, HIGH, SCALE = 1 << 15, 2, 4, 50.0
LETTER = re.compile(r"[^\W\d_]")
#: Lower-cased text with ASCII digits and punctuation as blanks.
BLANK = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalpha()})


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages), the idf multiplied in
    bias: np.ndarray
    temperature: float


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().translate(BLANK).split()


def grams() -> Subwords:
    return Subwords(LOW, HIGH, BUCKETS, whole=False)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts of `docs` have each feature, and how many texts there are."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subwords, known = grams(), {}
        df, n = np.zeros(BUCKETS, np.int64), 0
        for part in parts:
            for texts in batches(part["text"].fillna("")):
                split = [set(words_of(t)) for t in texts]
                new = list(set().union(*split).difference(known))
                if len(known) + len(new) > 200_000:
                    known, new = {}, list(set().union(*split))
                known.update(zip(new, subwords.apart(new)))
                for words in split:
                    has = np.zeros(BUCKETS, bool)
                    if words:
                        has[np.concatenate([known[w] for w in words])] = True
                    df += has
                n += len(split)
        if n:
            some = np.flatnonzero(df)
            yield pd.DataFrame({"bucket": np.append(some, -1), "df": np.append(df[some], n)})

    rows = docs.select("text").mapInPandas(count, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(BUCKETS + 1)
    df[rows["bucket"].to_numpy(int)] = rows["df"].to_numpy()  # -1: the last place
    return df[:-1], int(df[-1])


def features(text: str, subwords: Subwords, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their values."""
    often = Counter(words_of(text))
    if not often:
        return np.zeros(0, np.int64), np.zeros(0)
    owner, ids = subwords(list(often))
    distinct, at = np.unique(ids, return_inverse=True)
    count = np.bincount(at, np.array(list(often.values()), float)[owner])
    return distinct, SCALE * count / max(1.0, count.sum()) * idf[distinct]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by follow-the-regularised-leader, a document at a time."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def now(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[ids])) / alpha + l2))

    for order in (np.random.default_rng([seed, e]).permutation(len(rows)) for e in range(epochs)):
        for d in order:
            ids, x = np.append(rows[d][0], BUCKETS), np.append(rows[d][1], 1.0)  # the last is the bias
            w = now(ids)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[d]] -= 1.0
            g = np.outer(x, p)
            more = n[ids] + g * g
            z[ids] += g - (np.sqrt(more) - np.sqrt(n[ids])) / alpha * w
            n[ids] = more
    w = now(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes the labels likeliest."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        scaled = logits / t
        scaled = scaled - scaled.max(axis=1, keepdims=True)
        return float((np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(y)), y]).mean())

    return float(min(np.geomspace(0.05, 20.0, 241), key=loss))


def train(docs: DataFrame, per_class: int = 600, folds: int = 4, held: int = 2, longest: int = LONGEST) -> Model:
    """A model from text and lang of the documents outside fold `held`."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    df, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    place = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_class / counts[lang]))])
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where((uniform < share[F.col("lang")]) & (F.coalesce(F.length("text"), F.lit(0)) <= longest))
    sample = drawn.groupBy("doc_id", place[F.col("lang")].alias("y")).agg(F.min("text").alias("text"))

    def learn(rows: pd.DataFrame) -> Model:
        subwords = grams()
        x = [features(t, subwords, idf) for t in rows["text"].fillna("")]
        y = rows["y"].to_numpy()
        kept = np.arange(len(x)) % 5 == 4
        weights, bias = ftrl([r for r, k in zip(x, kept) if not k], y[~kept], len(languages))
        logits = np.array([v @ weights[i] + bias for (i, v), k in zip(x, kept) if k]).reshape(-1, len(languages))
        return Model(languages, SCALE * idf[:, None] * weights, bias, temperature(logits, y[kept]))

    return fit_in_task(sample, learn)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.subwords = model, grams()
        self.words = Lexicon(self._rows)

    def _rows(self, words: list[str]) -> np.ndarray:
        owner, ids = self.subwords(words)
        columns = [np.bincount(owner, self.model.weights[ids, c], minlength=len(words)) for c in range(len(self.model.languages))]
        return np.stack([*columns, np.bincount(owner, minlength=len(words))], axis=1)

    def documents(self, texts: pd.Series) -> pd.DataFrame:
        split = [words_of(t) for t in texts]
        total = sums(self.words([w for words in split for w in words]), [len(words) for words in split])
        logits = (total[:, :-1] / np.maximum(total[:, -1:], 1) + self.model.bias) / self.model.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        known = np.array([LETTER.search(t) is not None for t in texts], bool)
        return pd.DataFrame({
            "lang_pred": np.where(known, np.array(self.model.languages, object)[best], "und"),
            "score": np.where(known, p[np.arange(len(p)), best], 0.0),
        })


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score."""
    names = ("lang_pred", "score")
    if not model.languages:
        return docs.select(*without(docs, *names), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in parts:
            done = [scorer.documents(part) for part in batches(texts.fillna(""))]
            yield pd.concat(done, ignore_index=True) if done else pd.DataFrame({"lang_pred": [], "score": []})

    own = unused(docs, "_language")
    found = docs.withColumn(own, predict(F.col("text")))
    return found.select(*without(docs, *names), *(F.col(f"{own}.{c}").alias(c) for c in names))
