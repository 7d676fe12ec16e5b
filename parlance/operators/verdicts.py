"""Reading models' verdicts: what a listener inferred, and what a judge found in a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import REACTIONS, evidence_in, words


def inferred(reply: Column, present: Column) -> Column:
    """struct(subject, predicted, spurious, reason) of a JSON reply about the sounds with the ids `present`.

    predicted: (event_id, reaction), the first for each present event; spurious: ids that aren't there. A reply that
    can't be used has only a reason: the first that applies, sounds looked at in their order.
    """
    parsed = F.from_json(reply, "subject string, sounds array<string>")
    subject = F.trim(F.coalesce(parsed["subject"], F.lit("")))
    element = lambda s, name: F.trim(F.coalesce(F.get_json_object(s, f"$.{name}"), F.lit("")))
    sounds = F.transform(parsed["sounds"], lambda s: F.struct(element(s, "event_id").alias("event_id"), F.lower(element(s, "reaction")).alias("reaction"), F.coalesce(F.trim(s).startswith("{"), F.lit(False)).alias("fine")))
    fault = lambda s: F.when(~s["fine"], "a sound is no object").when(~s["reaction"].isin(*REACTIONS), "invalid reaction").when(s["event_id"] == "", "empty event_id")
    faults = F.filter(F.transform(sounds, fault), lambda f: f.isNotNull())
    here = F.filter(sounds, lambda s: F.array_contains(present, s["event_id"]))
    first = F.filter(F.transform(here, lambda s, i: F.when(F.array_position(F.transform(here, lambda h: h["event_id"]), s["event_id"]) == i + 1, F.struct(s["event_id"].alias("event_id"), s["reaction"].alias("reaction")))), lambda s: s.isNotNull())
    spurious = F.transform(F.filter(sounds, lambda s: ~F.array_contains(present, s["event_id"])), lambda s: s["event_id"])
    reason = (
        F.when(~F.coalesce(F.trim(reply).startswith("{"), F.lit(False)), "not an object")
        .when(F.size(words(subject)) < 2, "subject empty or too short").when(parsed["sounds"].isNull(), "sounds is not a list").when(F.size(faults) > 0, F.get(faults, F.lit(0)))
        .when((F.size(present) > 0) & (F.size(sounds) == 0), "no sound typed")
    )
    fine = reason.isNull()
    return F.struct(F.when(fine, subject).alias("subject"), F.when(fine, first).alias("predicted"), F.when(fine, spurious).alias("spurious"), reason.alias("reason"))


def judged(verdicts: Column, names: Column, summary: Column) -> Column:
    """struct(heard, nature, discussed, off_list, no_evidence): names by what a judge says about each.

    verdicts: a JSON list of (sound, verdict, evidence). Elements that are no objects and verdicts of another name say
    nothing; sounds that aren't among `names` and evidence that the summary doesn't quote are put aside. A sound
    counts once: heard before nature before discussed.
    """
    text = lambda s, name: F.coalesce(F.get_json_object(s, f"$.{name}"), F.lit(""))
    listed = F.filter(F.from_json(verdicts, "array<string>"), lambda s: F.trim(s).startswith("{"))
    rows = F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda s: F.struct(text(s, "sound").alias("sound"), text(s, "verdict").alias("verdict"), evidence_in(F.get_json_object(s, "$.evidence"), summary).alias("quoted")))
    known = F.filter(rows, lambda r: F.array_contains(names, r["sound"]))
    clear = F.filter(known, lambda r: r["verdict"].isin("heard", "nature", "discussed"))
    sounds = lambda kept: F.transform(kept, lambda r: r["sound"])
    of = lambda verdict: sounds(F.filter(clear, lambda r: r["quoted"] & (r["verdict"] == verdict)))
    heard, nature, discussed = map(of, ("heard", "nature", "discussed"))
    without = lambda a, *others: F.filter(a, lambda x: ~F.array_contains(F.concat(*others), x))
    return F.struct(
        heard.alias("heard"), without(nature, heard).alias("nature"), without(discussed, heard, nature).alias("discussed"),
        sounds(F.filter(rows, lambda r: ~F.array_contains(names, r["sound"]))).alias("off_list"), sounds(F.filter(clear, lambda r: ~r["quoted"])).alias("no_evidence"),
    )


def summary_scores(records: DataFrame, by_budget: bool = True, with_rare: bool = True) -> DataFrame:
    """(budget,) reaction, n_present, n_mentioned, n_discussed, share_present, share_mentioned, recall.

    records: scenario_id, budget, summary, mentioned and discussed (arrays of names), gold (array of name, reaction,
    is_rare). Without `by_budget` a sound of a scenario counts once, as mentioned if it is at any budget. Sounds without a
    reaction don't count, nor do records with neither a summary nor a mention.
    """
    used = records.where((F.size(F.coalesce("mentioned", F.array().cast("array<string>"))) > 0) | F.col("summary").isNotNull())
    rows = used.select("scenario_id", "budget", "mentioned", "discussed", F.explode("gold").alias("g")).where("g.reaction <> ''")
    rows = rows if with_rare else rows.where(~F.coalesce("g.is_rare", F.lit(False)))
    held = lambda c: F.coalesce(F.array_contains(c, F.col("g.name")), F.lit(False))
    rows = rows.select("scenario_id", "budget", F.col("g.name").alias("name"), F.col("g.reaction").alias("reaction"), held("mentioned").alias("m"), held("discussed").alias("d"))
    if not by_budget:
        rows = rows.groupBy("scenario_id", "name").agg(F.min_by("reaction", "budget").alias("reaction"), F.max("m").alias("m"), F.max("d").alias("d"))
    by = ["budget"] if by_budget else []
    counts = rows.groupBy(*by, "reaction").agg(F.count("*").alias("n_present"), F.count_if("m").alias("n_mentioned"), F.count_if("d").alias("n_discussed"))
    total = counts.groupBy(*by).agg(F.sum("n_present").alias("_p"), F.sum("n_mentioned").alias("_m"))
    both = counts.join(F.broadcast(total), by) if by else counts.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k").drop("_k")  # a row per budget
    shares = {"share_present": F.try_divide("n_present", "_p"), "share_mentioned": F.try_divide("n_mentioned", "_m"), "recall": F.try_divide("n_mentioned", "n_present")}
    return both.withColumns(shares).drop("_p", "_m")


def summary_lengths(records: DataFrame) -> DataFrame:
    """(budget, n_scenes, median_words, over_budget_rate, n_without): the upper median; over half more than the budget is over it."""
    used = records.where((F.size(F.coalesce("mentioned", F.array().cast("array<string>"))) > 0) | F.col("summary").isNotNull())
    n = F.when(F.col("summary") != "", F.size(words(F.col("summary"))).cast("long"))
    rows = used.select("budget", n.alias("w"), (F.size(F.coalesce("mentioned", F.array().cast("array<string>"))) == 0).alias("none"))
    from parlance.operators.metrics import upper_medians

    rates = rows.groupBy("budget").agg(F.count("*").alias("n_scenes"), F.try_divide(F.count_if(F.col("w") > 1.5 * F.col("budget")), F.count("w")).alias("over_budget_rate"), F.count_if("none").alias("n_without"))
    return rates.join(upper_medians(rows, "w", ("budget",)).select("budget", F.col("median").alias("median_words")), "budget", "left")


def _sounds(records: DataFrame) -> DataFrame:
    """(scenario_id, budget, name, reaction, is_rare, m): gold sounds with a reaction, of records with a summary or a mention."""
    used = records.where((F.size(F.coalesce("mentioned", F.array().cast("array<string>"))) > 0) | F.col("summary").isNotNull())
    rows = used.select("scenario_id", "budget", "mentioned", F.explode("gold").alias("g")).where("g.reaction <> ''")
    held = F.coalesce(F.array_contains("mentioned", F.col("g.name")), F.lit(False))
    return rows.select("scenario_id", "budget", F.col("g.name").alias("name"), held.alias("m"))


def mention_rates(records: DataFrame) -> DataFrame:
    """(budget, n_sounds, n_mentioned, mention_rate): of every budget's sounds how many its summaries mention; rates of nothing are null."""
    return _sounds(records).groupBy("budget").agg(F.count("*").alias("n_sounds"), F.count_if("m").alias("n_mentioned"), F.try_divide(F.count_if("m"), F.count("*")).alias("mention_rate"))


def mentions_over_budgets(records: DataFrame) -> DataFrame:
    """(n_budgets, n, mention_rate, budgets_per_mentioned): how many sounds of a scene are mentioned at how many of its budgets, 0 too.

    The last two are of all sounds, on every row.
    """
    each = _sounds(records).groupBy("scenario_id", "name").agg(F.count_distinct(F.when(F.col("m"), F.col("budget"))).alias("n_budgets"))
    counts = each.groupBy("n_budgets").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_n"), F.coalesce(F.sum(F.when(F.col("n_budgets") > 0, F.col("n"))), F.lit(0)).alias("_m"), F.sum(F.col("n") * F.col("n_budgets")).alias("_p"))
    rates = counts.join(F.broadcast(whole), F.lit(True))  # one row
    return rates.select("n_budgets", "n", F.try_divide("_m", "_n").alias("mention_rate"), F.try_divide("_p", "_m").alias("budgets_per_mentioned"))


def judged_summaries(summaries: DataFrame, verdicts: DataFrame, key: str = "item_id") -> DataFrame:
    """`summaries` (key, summary, gold) with what a judge said of them (key, verdicts): judged(), its names being those of the gold sounds.

    A summary without a verdict has none (null), and a verdict without a summary is left out.
    """
    rows = summaries.join(verdicts.select(key, "verdicts"), key, "left")
    found = judged(F.col("verdicts"), F.transform("gold", lambda g: g["name"]), F.coalesce("summary", F.lit("")))
    return rows.withColumn("judged", F.when(F.col("verdicts").isNotNull(), found)).drop("verdicts")
