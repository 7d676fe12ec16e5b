"""Rejection sampling by recovery: acceptance, attempts, regeneration, finished rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.metrics import ratio


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a null, empty or zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def accepted(cos: Column, reactions_ok: Column, tau: float) -> Column:
    """Whether the subject was recovered (cosine at least tau; null is not) and all reactions were."""
    return F.coalesce(cos >= tau, F.lit(False)) & F.coalesce(reactions_ok, F.lit(False))


def typed_events(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """gold (keys, gold) with its prediction; 'missing' where there is none. Of repeated predictions the first by ordinal counts."""
    first = predicted.groupBy(*keys).agg(F.min_by("pred", "ordinal").alias("pred"))
    return gold.join(first, keys, "left").withColumn("pred", F.coalesce("pred", F.lit("missing")))


def recovery(typed: DataFrame, key: str, confirmed: Column) -> DataFrame:
    """Per scenario: sounds, correct ones, missing ones, and those rescued.

    A behavioral sound heard as ambient counts as correct where its delivery tag confirms it; the pair stays
    an error in the confusion matrix.
    """
    equal = F.col("gold") == F.col("pred")
    rescued = ~equal & (F.col("gold") == "behavioral") & (F.col("pred") == "ambient") & confirmed
    rows = typed.groupBy(key).agg(
        F.count("*").alias("n_sounds"), F.count_if(equal | rescued).alias("n_correct"), F.count_if(F.col("pred") == "missing").alias("n_missing"), F.count_if(rescued).alias("n_rescued")
    )
    return rows.withColumn("reactions_ok", F.col("n_correct") == F.col("n_sounds"))


def pending(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Candidates that nothing valid is stored for."""
    return candidates.join(done.select(key), key, "left_anti")


def without(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """`stored` without the rows whose key is listed, which are to be made again. Rows without a key stay."""
    listed = ids.select(F.col(key).cast("string").alias("_id")).where("_id <> ''").distinct()
    return stored.join(listed, F.col(key).cast("string") == F.col("_id"), "left_anti")


def next_steps(scenarios: DataFrame, accepted_ids: DataFrame, attempts: DataFrame, key: str, most: int) -> DataFrame:
    """`scenarios` with n_attempts and state: accepted, abandoned (at `most` attempts) or regenerate."""
    tries = attempts.groupBy(key).agg(F.count("*").alias("n_attempts"))
    rows = scenarios.join(accepted_ids.select(key, F.lit(True).alias("_in")), key, "left").join(tries, key, "left")
    rows = rows.withColumn("n_attempts", F.coalesce("n_attempts", F.lit(0)).cast("long"))
    state = F.when(F.col("_in"), "accepted").when(F.col("n_attempts") >= most, "abandoned").otherwise("regenerate")
    return rows.withColumn("state", state).drop("_in")


def stratum_acceptance(steps: DataFrame, first_try: DataFrame, key: str, stratum: str) -> DataFrame:
    """Per stratum: scenarios, accepted, rate, those accepted at the first try, their rate, and mean attempts of all scenarios."""
    rows = steps.join(first_try.select(key, F.col("accepted").alias("_first")), key, "left")
    ok = F.col("state") == "accepted"
    first = F.count_if(ok & F.coalesce("_first", F.lit(False)))
    return rows.groupBy(stratum).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_accepted"), ratio(F.count_if(ok), F.count("*")).alias("acceptance_rate"),
        first.alias("n_first_try"), ratio(first, F.count("*")).alias("first_try_rate"), ratio(F.sum("n_attempts"), F.count("*")).alias("mean_attempts"),
    )


def regeneration_report(steps: DataFrame, last: DataFrame, key: str, rare: str = "has_rare", pivot: str = "has_pivot") -> DataFrame:
    """One row over next_steps(): scenarios by state, acceptance in all, with and without a rare event, with a pivot, and rescued sounds.

    last: (key, n_rescued) of each attempted scenario's last attempt, also of those that `steps` doesn't know.
    """
    ok, known = F.col("state") == "accepted", lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = steps.agg(
        F.count("*").alias("n"), *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("accepted", "regenerate", "abandoned")], ratio(F.count_if(ok), F.count("*")).alias("acceptance_rate"),
        *[x for name, of in (("rare", known(rare)), ("usual", ~known(rare)), ("pivot", known(pivot))) for x in (F.count_if(of).alias(f"n_{name}"), F.count_if(of & ok).alias(f"n_{name}_accepted"), ratio(F.count_if(of & ok), F.count_if(of)).alias(f"{name}_rate"))],
    )
    return rows.join(F.broadcast(last.agg(F.coalesce(F.sum("n_rescued"), F.lit(0)).alias("n_rescued"))), F.lit(True))  # two single rows


def evaluated(scenarios: DataFrame, inferences: DataFrame, key: str) -> DataFrame:
    """`scenarios` with what was inferred for them, if it was evaluated.

    inferences: (key, subject_cos, pairs, n_sounds, n_missing, n_spurious, reactions_ok), pairs an array of (gold, pred); all null but the
    key where an evaluation is missing. Left out: scenarios without an evaluation, and those with sounds where neither a subject nor a
    pair came out, as nothing was heard there.
    """
    fields = ("subject_cos", "pairs", "n_sounds", "n_missing", "n_spurious", "reactions_ok")
    some = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    nothing = F.col("subject_cos").isNull() & (F.coalesce(F.size("pairs"), F.lit(0)) <= 0) & (F.coalesce("n_sounds", F.lit(0)) > 0)
    return scenarios.join(inferences.where((some > 0) & ~nothing).select(key, *fields), key)


def recovery_metrics(rows: DataFrame, tau: float, reactions: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Over evaluated(): scenarios, sounds, typed, missing and spurious ones, share of right sounds, subjects, their mean cosine, and the rates of recovered subjects, exact reactions and acceptance.

    Rates of nothing are null.
    """
    count = lambda f: F.coalesce(F.size(F.filter("pairs", f)), F.lit(0))
    topic, exact = F.coalesce(F.col("subject_cos") >= tau, F.lit(False)), F.coalesce("reactions_ok", F.lit(False))
    own = rows.select(*by, "subject_cos", topic.alias("_topic"), exact.alias("_exact"), "n_missing", "n_spurious", F.greatest(F.coalesce(F.size("pairs"), F.lit(0)), F.lit(0)).alias("_n"),
        F.greatest(count(lambda p: p["pred"].isin(*reactions)), F.lit(0)).alias("_typed"), F.greatest(count(lambda p: (p["gold"] == p["pred"]) & p["gold"].isin(*reactions)), F.lit(0)).alias("_right"))
    return own.groupBy(*by).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_sounds"), F.coalesce(F.sum("_typed"), F.lit(0)).alias("n_typed"), F.coalesce(F.sum("n_missing"), F.lit(0)).alias("n_missing"), F.coalesce(F.sum("n_spurious"), F.lit(0)).alias("n_spurious"),
        ratio(F.sum("_right"), F.sum("_n")).alias("sound_accuracy"), F.count("subject_cos").alias("n_subjects"), F.avg("subject_cos").alias("mean_cosine"),
        ratio(F.count_if("_topic"), F.count("*")).alias("topic_rate"), ratio(F.count_if("_exact"), F.count("*")).alias("reaction_rate"), ratio(F.count_if(F.col("_topic") & F.col("_exact")), F.count("*")).alias("accept_rate"),
    )


def first_and_last(history: DataFrame, key: str, ordinal: str, value: str) -> DataFrame:
    """(key, first, last, n): values of a log at its ends."""
    return history.groupBy(key).agg(F.min_by(value, ordinal).alias("first"), F.max_by(value, ordinal).alias("last"), F.count("*").alias("n"))


def carried(dialogue: Column, scenario: Column) -> Column:
    """A dialogue's own value if it isn't empty, else its scenario's."""
    return F.coalesce(F.nullif(dialogue, F.lit("")), scenario)


def finish(accepted_rows: DataFrame, scenarios: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Accepted dialogues with their scenario's fields where they lack their own; rows without a scenario stay."""
    other = scenarios.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    rows = accepted_rows.join(other, key, "left")
    return rows.withColumns({f: carried(F.col(f), F.col(f"_{f}")) for f in fields}).drop(*[f"_{f}" for f in fields])


def near_vectors(vectors: DataFrame, key: str, vector: str, group: str, tau: float, cell: int = 2048) -> DataFrame:
    """(group, a, b, cosine) of vectors of one group with a cosine of at least tau, a < b.

    A group of n vectors is dealt into n / `cell` cells by a hash of the key; every pair of cells is a task's work, a
    product of two small matrices, so that a large group is spread over many. Only pairs over tau are put out. Vectors that are null,
    zero or hold null or non-finite components take no part, and neither do null groups; vectors are of one length.
    """
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(group).alias("g")).where("k IS NOT NULL AND g IS NOT NULL AND exists(v, x -> x <> 0) AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    cells = rows.groupBy("g").agg(F.ceil(F.count("*") / cell).cast("int").alias("cells"))
    placed = rows.join(cells, "g").withColumn("c", F.pmod(F.xxhash64("k"), F.col("cells")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    paired = placed.select("g", "k", "v", "c", F.least("c", "other").alias("low"), F.greatest("c", "other").alias("high"))

    def compare(place: tuple, own: pd.DataFrame) -> pd.DataFrame:
        _, low, high = place
        unit = np.stack(own["v"])
        unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        keys, left, right = own["k"].to_numpy(), np.flatnonzero(own["c"] == low), np.flatnonzero(own["c"] == high)
        cosine = unit[left] @ unit[right].T
        near = cosine >= tau
        if low == high:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        a, b = keys[left[i]], keys[right[j]]
        return pd.DataFrame({"g": [place[0]] * len(i), "a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": cosine[i, j]})

    kind = lambda c: rows.schema[c].dataType.simpleString()
    found = paired.groupBy("g", "low", "high").applyInPandas(compare, f"g {kind('g')}, a {kind('k')}, b {kind('k')}, cosine double")
    return found.where("a < b").withColumnRenamed("g", group)
