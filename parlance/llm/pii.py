"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Looser patterns propose more
candidates: obfuscated addresses, IPv6, numbers in national formats or with other separators, and secrets
after an assignment. Labelers (patterns, checksums, gazetteers, contexts) vote on every candidate, base ones
included: for, against, or not at all. Expectation-maximisation (a naive Bayes model with one accuracy table
per labeler) estimates the labelers' reliabilities and a posterior for every candidate without any label.
A logistic regression on surface and context features is then trained on these posteriors and decides about
the candidates that aren't base spans.

All documents take part: the executors count candidates by their pattern of kind, votes and features, which
are small categories, and the driver gets those counts alone. Documents are never shuffled.

Defined results: a null text is empty and has no spans. Added spans never overlap a base span or each other
(higher scores first, ties to the earlier). Positions are code points, ends exclusive. Texts are read whole.
Repeated rows and null ids are kept. Input columns called like an output are replaced. An empty table gives
an empty result, and without candidates nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import sigmoid, unused, without

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
Span = tuple[int, int, int]  # start, end, kind

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9][0-9().\x20/-]{6,30}[0-9](?![0-9A-Za-z])")
LOOSE_EMAIL = re.compile(r"([A-Za-z0-9._%+-]{1,64})[\x20]?[\[({](?:at|@)[\])}][\x20]?([A-Za-z0-9-]{1,64}(?:(?:\.|[\x20]?[\[({](?:dot|\.)[\])}][\x20]?)[A-Za-z0-9-]{1,24}){1,4})", re.I)
LOOSE_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
ASSIGNED = re.compile(r"[=:][\x20]?[\"']?([A-Za-z0-9_+/.-]{8,200})")

#: Gazetteers. Top-level domains, leading digits of card issuers, and calling codes.
DOMAINS = frozenset("com org net edu gov int info biz io co de fr es it uk eu us ca ch at nl be pt".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "61", "81", "86", "91")
#: Contexts: words shortly before a span.
HINTS = {
    "email": re.compile(r"mail|contact|write|address", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|addr", re.I),
    "card": re.compile(r"card|visa|credit|pay|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|cell|whatsapp", re.I),
    "secret": re.compile(r"token|passw|secret|api|key|pwd|auth|credential", re.I),
}
UNLIKELY = re.compile(r"isbn|issn|order|version|chapter|page|year|doi|http|www|§|nr\.|no\.$|license", re.I)


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, leftmost and non-overlapping within a kind, by start, then kind."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, end := found.end(), 0))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(number := digits(m[0])) <= 19 and luhn(number):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits(m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates of the looser patterns that overlap no base span."""
    out: list[Span] = []
    for m in LOOSE_NUMBER.finditer(text):
        n = len(digits(m[0]))
        if 7 <= n <= 11:
            out.append((m.start(), m.end(), 3))
        elif 12 <= n <= 19:
            out.append((m.start(), m.end(), 2))
    if "at" in text or "AT" in text or "@" in text:
        if re.search(r"[\[({](?:at|@)[\])}]", text, re.I):
            out += [(m.start(), m.end(), 0) for m in LOOSE_EMAIL.finditer(text)]
    if text.count(":") >= 3:
        out += [(m.start(), m.end(), 1) for m in LOOSE_IP.finditer(text)]
    out += [(m.start(1), m.end(1), 4) for m in ASSIGNED.finditer(text)]
    taken = Taken(base)
    return [c for c in out if taken.free(c)]


class Taken:
    """Places that spans hold: their disjoint union, in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, span: Span) -> bool:
        at = bisect_right(self.ends, span[0])
        return at == len(self.starts) or self.starts[at] >= span[1]

    def add(self, span: Span) -> None:
        """A span that is free."""
        at = bisect_right(self.ends, span[0])
        self.starts.insert(at, span[0])
        self.ends.insert(at, span[1])


def votes(text: str, span: Span, is_base: bool) -> tuple[int, ...]:
    """Each labeler's vote: 1 for personal data, -1 against, 0 none."""
    start, end, k = span
    own, kind, number = text[start:end], KINDS[k], digits(text[start:end])
    before = text[max(0, start - 32) : start]
    mixed = len({c.isdigit() for c in own}) == 2
    # patterns
    pattern = 1 if is_base else 0
    # checks of the content
    if kind == "card":
        check = 1 if luhn(number) else -1
    elif kind == "ip":
        check = 1 if is_base or own.count(":") == 7 else -1
    elif kind == "phone":
        check = 1 if re.fullmatch(r"\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}", own) else -1 if re.fullmatch(r"[0-9]+|[0-9.]+|[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}.*", own) else 0
    elif kind == "email":
        check = 1 if "." in own or "dot" in own.lower() else -1
    else:
        check = 1 if mixed and len(own) >= 10 and len(set(own)) >= 6 else -1
    # gazetteers
    if kind == "email":
        listed = 1 if re.split(r"[^A-Za-z]+", own.lower())[-1] in DOMAINS else 0
    elif kind == "card":
        listed = 1 if number.startswith(ISSUERS) else 0
    elif kind == "phone":
        listed = 1 if own.startswith("+") and number.startswith(CALLING) else 0
    elif kind == "ip":
        listed = -1 if number.startswith("0") else 0
    else:
        listed = 1 if re.fullmatch(r"[0-9a-f]{12,}|[A-Za-z0-9_+/-]{20,}", own) and mixed else -1 if own.lower().startswith(("www", "http", "//")) or not mixed else 0
    # contexts
    hint = 1 if HINTS[kind].search(before) else 0
    doubt = -1 if UNLIKELY.search(before[-16:]) or (kind in ("ip", "card", "phone") and before[-1:] in ("$", "#", "€", ".", ",")) else 0
    return pattern, check, listed, hint, doubt


def features(text: str, span: Span) -> tuple[int, ...]:
    """Small categories of a span and its surroundings: length, share of digits, neighbours, separators."""
    start, end, _ = span
    own = text[start:end]
    share = sum(c.isdigit() for c in own) / max(1, len(own))

    def side(c: str) -> int:
        return 0 if not c else 1 if c.isspace() else 2 if c in "\"'([{<" or c in "\"')]}>" else 3 if c.isalnum() else 4

    return min(7, len(own) // 5), int(share * 3.999), side(text[start - 1 : start]), side(text[end : end + 1]), min(3, sum(c in " .-()" for c in own)), int(own[:1] == "+"), int(bool(re.search(r"[A-Z]", own)))


SIZES = (8, 4, 5, 5, 4, 2, 2)


@dataclass
class Model:
    reliabilities: np.ndarray  # (labelers, 2 classes, 3 votes)
    weights: np.ndarray
    bias: float


def one_hot(kind: np.ndarray, cast: np.ndarray, feats: np.ndarray) -> np.ndarray:
    parts = [np.eye(len(KINDS))[kind]]
    parts += [np.eye(3)[cast[:, j] + 1] for j in range(1, cast.shape[1])]  # not the base pattern's own vote
    parts += [np.eye(n)[feats[:, j]] for j, n in enumerate(SIZES)]
    return np.concatenate(parts, axis=1)


def expectation_maximisation(kind: np.ndarray, cast: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern and the labelers' tables P(vote | class), from votes alone."""
    posterior = sigmoid(1.5 * cast.sum(axis=1) - 0.5)
    hot = np.stack([np.eye(3)[cast[:, j] + 1] for j in range(cast.shape[1])], axis=1)  # pattern, labeler, vote
    for _ in range(rounds):
        share = np.stack([1 - posterior, posterior], axis=1) * count[:, None]
        table = np.einsum("pc,pjv->jcv", share, hot) + np.array([[2.0, 4.0, 0.5], [0.5, 4.0, 2.0]])  # a vote is likelier right than wrong
        table /= table.sum(axis=2, keepdims=True)
        prior = np.stack([np.bincount(kind, share[:, c], minlength=len(KINDS)) + 1 for c in (0, 1)])
        log = np.log(prior / prior.sum(axis=0))[:, kind] + np.einsum("jcv,pjv->cp", np.log(table), hot)
        posterior = sigmoid(log[1] - log[0])
    return posterior, table


def fit(x: np.ndarray, target: np.ndarray, count: np.ndarray, rounds: int = 400, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, each pattern as often as it was counted (damped), by gradient descent."""
    weight = np.sqrt(count)
    weight = weight / weight.sum()
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        g = weight * (sigmoid(x @ w + b) - target)
        w -= 4.0 * (x.T @ g + l2 * w)
        b -= 4.0 * g.sum()
    return w, b


def train(docs: DataFrame) -> Model | None:
    """Reliabilities and span classifier from all texts of `docs`; None if nothing is a candidate."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for part in parts:
            for text in part["text"].dropna():
                base = base_spans(text)
                for span, is_base in [*((s, True) for s in base), *((s, False) for s in loose_spans(text, base))]:
                    seen[(span[2], *votes(text, span, is_base), *features(text, span))] += 1
        if seen:
            yield pd.DataFrame({"pattern": [list(p) for p in seen], "n": list(seen.values())})

    rows = docs.select("text").mapInPandas(count, "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    if rows.empty:
        return None
    patterns = np.array(sorted(zip(map(tuple, rows["pattern"]), rows["n"])), dtype=object)
    table, n = np.array([p for p, _ in patterns], int), np.array([c for _, c in patterns], float)
    kind, cast, feats = table[:, 0], table[:, 1:6], table[:, 6:]
    posterior, reliabilities = expectation_maximisation(kind, cast, n)
    weights, bias = fit(one_hot(kind, cast, feats), posterior, n)
    return Model(reliabilities, weights, bias)


class Finder:
    def __init__(self, model: Model | None, threshold: float = 0.5):
        self.model, self.threshold = model, threshold
        self.scores: dict[tuple, float] = {}  # of patterns, which are few

    def score(self, pattern: tuple) -> float:
        found = self.scores.get(pattern)
        if found is None:
            p = np.array([pattern])
            found = self.scores[pattern] = float(sigmoid(one_hot(p[:, 0], p[:, 1:6], p[:, 6:]) @ self.model.weights + self.model.bias)[0])
        return found

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans by start, then kind."""
        base = base_spans(text)
        if self.model is None:
            return base, base
        scored = []
        for span in loose_spans(text, base):
            p = self.score((span[2], *votes(text, span, False), *features(text, span)))
            if p >= self.threshold:
                scored.append((-p, span))
        taken, added = Taken([]), []
        for _, span in sorted(scored):
            if taken.free(span):
                taken.add(span)
                added.append(span)
        return base, sorted([*base, *added], key=lambda s: (s[0], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


DIGEST = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def find(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """`docs` with counts of base spans by kind, their digest, and all spans as kind:start:end,..."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def detect(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Finder(shared.value, threshold)
        for texts in parts:
            rows = []
            for text in texts:
                base, every = finder.spans(text or "")
                counts = Counter(k for _, _, k in base)
                rows.append((*(counts[k] for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            yield pd.DataFrame(rows, columns=list(DIGEST))

    own = unused(docs, "_pii")
    found = docs.withColumn(own, detect(F.col("text")))
    return found.select(*without(docs, *DIGEST), *(F.col(f"{own}.{c}").alias(c) for c in DIGEST))


def redact(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """`docs` with every span of its text replaced by its kind, as <EMAIL>; overlapping spans become one.

    A null text stays null. n_chars, if there is such a column, is counted anew.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def replace(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(shared.value, threshold)
        for texts in parts:
            yield texts.map(lambda t: None if t is None else cover(t, finder.spans(t)[1]))

    out = docs.withColumn("text", replace(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def cover(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text
