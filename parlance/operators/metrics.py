"""Agreement and recovery metrics over (gold, predicted) pairs.

Every function takes a frame with string columns `gold` and `pred`, a count column `n`, and optionally
grouping columns `by`. Classes are given as an ordered list, so that classes that never occur have their
zero rows: those are unioned in before the aggregation, not produced by a cross join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null if b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def count_pairs(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy(*by, "gold", "pred").agg(F.count("*").alias("n"))


def _zero(counts: DataFrame, by: tuple[str, ...], **literals: list[str]) -> DataFrame:
    """A row for every group of `counts` and every combination of the literals."""
    groups = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    for name, values in literals.items():
        groups = groups.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return groups


def dense_confusion(counts: DataFrame, classes: list[str], extra: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, gold, pred, n) with zeros; predictions outside `classes` count as `extra`, if it is given."""
    if extra:
        counts = counts.withColumn("pred", F.when(F.col("pred").isin(classes), F.col("pred")).otherwise(extra))
    zeros = _zero(counts, by, gold=classes, pred=[*classes, extra] if extra else classes).withColumn("n", F.lit(0).cast("long"))
    rows = counts.where(F.col("gold").isin(classes)).select(*by, "gold", "pred", F.col("n").cast("long").alias("n"))
    return rows.unionByName(zeros).groupBy(*by, "gold", "pred").agg(F.sum("n").alias("n"))


def row_normalised(confusion: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each count's share of its gold class; 0 where the class has no row."""
    total = F.sum("n").over(Window.partitionBy(*by, "gold"))
    return confusion.withColumn("share", F.coalesce(ratio(F.col("n"), total), F.lit(0.0)))


def per_class(counts: DataFrame, classes: list[str], by: tuple[str, ...] = (), empty: float | None = None) -> DataFrame:
    """(by, class, tp, fp, fn, support, precision, recall, f1).

    empty=None: a ratio without a divisor is null, f1 is 0 if the class occurs but is never hit, and null if
    it doesn't occur. empty=0.0: all of them are 0.
    """
    hit = (F.col("gold") == F.col("pred")).cast("long") * F.col("n")
    sides = counts.select(*by, F.explode(F.array(
        F.struct(F.col("gold").alias("class"), hit.alias("tp"), F.lit(0).cast("long").alias("fp"), (F.col("n") - hit).alias("fn")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), (F.col("n") - hit).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )).alias("s")).select(*by, "s.*").where(F.col("class").isin(classes))
    zeros = reduce(lambda df, c: df.withColumn(c, F.lit(0).cast("long")), ("tp", "fp", "fn"), _zero(counts, by, **{"class": classes}))
    rows = sides.unionByName(zeros).groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    rows = rows.withColumn("support", F.col("tp") + F.col("fn"))
    rows = rows.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    f1 = F.when(F.col("tp") > 0, ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).when(F.col("support") > 0, F.lit(0.0))
    rows = rows.withColumn("f1", f1)
    if empty is not None:
        rows = rows.fillna(empty, ["precision", "recall", "f1"])
    return rows


def macro(classes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over the classes that occur; a null ratio of such a class counts as 0."""
    seen = F.col("support") > 0
    mean = lambda c: F.avg(F.when(seen, F.coalesce(F.col(c), F.lit(0.0))))
    return classes.groupBy(*by).agg(mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"), mean("f1").alias("macro_f1"))


def kappa(counts: DataFrame, classes: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Cohen's kappa of the pairs with a valid prediction; null without any, and if chance agreement is 1."""
    valid = counts.where(F.col("pred").isin(classes))
    sides = valid.select(*by, "n", (F.col("gold") == F.col("pred")).alias("same"), F.explode(F.array(F.struct(F.lit(True).alias("is_gold"), F.col("gold").alias("class")), F.struct(F.lit(False).alias("is_gold"), F.col("pred").alias("class")))).alias("s"))
    marginal = sides.groupBy(*by, "s.class").agg(
        F.sum(F.when(F.col("s.is_gold"), F.col("n")).otherwise(0)).alias("g"), F.sum(F.when(~F.col("s.is_gold"), F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("s.is_gold") & F.col("same"), F.col("n")).otherwise(0)).alias("hit"),
    )
    total = marginal.groupBy(*by).agg(F.sum("g").cast("double").alias("total"), F.sum("hit").cast("double").alias("hits"), F.sum(F.when(F.col("class").isin(classes), F.col("g").cast("double") * F.col("p"))).alias("agree"))
    observed, expected = F.col("hits") / F.col("total"), F.col("agree") / (F.col("total") * F.col("total"))
    return total.select(*by, observed.alias("observed"), expected.alias("expected"), F.when(expected < 1, (observed - expected) / (1 - expected)).alias("kappa"))


def mcnemar_p(correct: Column, reverse: Column) -> Column:
    """Exact two-sided binomial p of the discordant pairs, at most 1, and 1 without any.

    Terms are summed from their logarithms, so that large counts don't overflow.
    """
    n, k = (correct + reverse).cast("int"), F.greatest(correct, reverse).cast("int")
    # log of C(n, i) by the recurrence over i, from i = n downwards to k
    steps = F.sequence(F.lit(0), n - k)
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    term = lambda acc, j: F.when(j == 0, F.lit(0.0)).otherwise(acc["log"] + F.log((n - j + 1).cast("double")) - F.log(F.greatest(j, F.lit(1)).cast("double")))
    folded = F.aggregate(steps, start, lambda acc, j: F.struct(term(acc, j).alias("log"), (acc["sum"] + F.exp(term(acc, j) - n * F.log(F.lit(2.0)))).alias("sum")))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * folded["sum"]))


def paired_table(items: DataFrame, pair: str = "pair_id") -> DataFrame:
    """One row of figures over items (pair, gold boolean, pred boolean or null).

    A pair is complete if it has both sides. A pair with an unreadable side is in none of the four cells but
    counts among the pairs.
    """
    sides = items.groupBy(pair).agg(
        F.max(F.when(F.col("gold"), F.struct("pred"))).alias("present"), F.max(F.when(~F.col("gold"), F.struct("pred"))).alias("muted"),
        F.count("*").alias("items"), F.count_if(F.col("gold")).alias("n_present"), F.count_if(~F.col("gold")).alias("n_muted"),
        F.count_if(F.col("gold") & F.col("pred")).alias("hits"), F.count_if(~F.col("gold") & F.col("pred")).alias("alarms"), F.count_if(F.col("pred").isNull()).alias("unread"),
    )
    full = F.col("present").isNotNull() & F.col("muted").isNotNull()
    yes, no = F.col("present.pred"), F.col("muted.pred")
    cells = sides.agg(
        F.count_if(full).alias("n_pairs"), F.sum("items").alias("n_items"), F.sum("unread").alias("n_unreadable"),
        F.count_if(full & yes & ~no).alias("correct"), F.count_if(full & ~yes & no).alias("reversed"), F.count_if(full & yes & no).alias("always_yes"), F.count_if(full & ~yes & ~no).alias("always_no"),
        F.coalesce(ratio(F.sum("hits"), F.sum("n_present")), F.lit(0.0)).alias("hit_rate"), F.coalesce(ratio(F.sum("alarms"), F.sum("n_muted")), F.lit(0.0)).alias("false_alarm_rate"),
    )
    cells = cells.withColumn("paired_accuracy", F.coalesce(ratio(F.col("correct"), F.col("n_pairs")), F.lit(0.0))).withColumn("sensitivity", F.col("hit_rate") - F.col("false_alarm_rate"))
    cells = cells.withColumn("mcnemar_p", mcnemar_p(F.col("correct"), F.col("reversed")))
    return cells.withColumn("verdict", F.when((F.col("mcnemar_p") < 0.05) & (F.col("correct") > F.col("reversed")), "discriminates").otherwise("does not discriminate"))


def upper_medians(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, median): the upper median per group, from counts of distinct values and their running sum."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("c").over(Window.partitionBy(*by))
    ranked = counts.select(*by, value, F.sum("c").over(order).alias("reach"), total.alias("n"))
    return ranked.where(F.col("reach") > F.floor(F.col("n") / 2)).groupBy(*by).agg(F.first("n").alias("n"), F.min(value).alias("median"))


def top_k(df: DataFrame, value: str, ordinal: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, value, n, rank): the k most frequent values, ties to the value that occurs first by `ordinal`."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first")


def shares_against_base(rows: DataFrame, group: str, flag: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, group, n_present, n_mentioned, share_present, share_mentioned, recall, lift).

    lift is the share among the mentioned less the share among all.
    """
    counts = rows.groupBy(*by, group).agg(F.count("*").alias("n_present"), F.count_if(flag).alias("n_mentioned"))
    whole = Window.partitionBy(*by)
    counts = counts.withColumn("share_present", ratio(F.col("n_present"), F.sum("n_present").over(whole))).withColumn("share_mentioned", ratio(F.col("n_mentioned"), F.sum("n_mentioned").over(whole)))
    return counts.withColumn("recall", ratio(F.col("n_mentioned"), F.col("n_present"))).withColumn("lift", F.col("share_mentioned") - F.col("share_present"))
