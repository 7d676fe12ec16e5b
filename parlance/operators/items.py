"""Evaluation items: one row to many, with options drawn by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import REACTIONS, pretty
from parlance.operators.catalog import one_list
from parlance.operators.metrics import ratio


def options(item: Column, gold: Column, candidates: Column, n: int = 4) -> Column:
    """Gold and the n - 1 distractors with the smallest hash of item|option, all ordered by another hash; null if too few."""
    key = lambda salt, x: F.sha1(F.concat_ws("|", F.lit(salt), item, x).cast("binary"))
    others = F.array_distinct(F.filter(candidates, lambda c: c != gold))
    drawn = F.slice(F.transform(F.array_sort(F.transform(others, lambda x: F.struct(key("draw", x).alias("k"), x.alias("o")))), lambda s: s["o"]), 1, n - 1)
    shown = F.transform(F.array_sort(F.transform(F.concat(F.array(gold), drawn), lambda x: F.struct(key("show", x).alias("k"), x.alias("o")))), lambda s: s["o"])
    return F.when(F.size(drawn) == n - 1, shown)


def summary_items(scenes: DataFrame, key: str, budgets: tuple[int, ...] = (25, 75, 200)) -> DataFrame:
    """A row per scene and word budget."""
    budget = F.explode(F.array(*[F.lit(b) for b in budgets]))
    return scenes.select("*", budget.alias("budget")).withColumn("item_id", F.concat_ws("::", F.col(key).cast("string"), F.lit("summary"), F.col("budget").cast("string")))


def grounding_items(manifests: DataFrame, muted: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Two items, present and muted, for each counterfactual: was this sound heard there?

    manifests: (key, scene, bed, audio, events_placed), one row per scene. muted: the same columns of the counterfactual scenes, whose events
    have `muted`, and `rank`, their folder's place in the list of folders. The first muted event counts, by its place among the events; there
    is no pair where the scene is unknown, nothing is muted, the scene has no event at that place, or the muted one no start.
    """
    first = F.array_position(F.transform("events_placed", lambda e: F.coalesce(e["muted"], F.lit(False))), F.lit(True)) - 1
    gone = muted.select(key, "rank", F.col("scene").alias("_scene"), F.col("audio").alias("_audio"), first.alias("_at"), F.get("events_placed", first.cast("int")).alias("_event")).where("_at >= 0 AND _event.start_s IS NOT NULL")
    both = gone.join(manifests.select(key, "bed", "audio", "events_placed"), key).where(F.col("_at") < F.size("events_placed"))
    heard, pair = F.get("events_placed", F.col("_at").cast("int")), _item(key, "pair", F.col("rank"))
    rows = both.select(key, F.col("_scene").alias("scene"), "audio", "_audio", pair.alias("pair_id"), F.col("_event.event_id").alias("event_id"), heard["start_s"].alias("start_s"), margin(heard["level_lufs"], F.col("bed")).alias("margin_db"), heard["reaction"].alias("reaction"), F.explode(F.array(F.lit(True), F.lit(False))).alias("gold"))
    item = F.concat_ws("::", "pair_id", F.when(F.col("gold"), "present").otherwise("muted"))
    return rows.select(item.alias("item_id"), "pair_id", key, "scene", F.when(F.col("gold"), F.col("audio")).otherwise(F.col("_audio")).alias("audio"), "event_id", "start_s", "margin_db", "reaction", "gold")


def score_choices(answers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy over (gold, answer): an unreadable (null) answer is wrong in `accuracy` and left out of `accuracy_on_readable`."""
    right = F.coalesce(F.col("answer") == F.col("gold"), F.lit(False))
    return answers.groupBy(*by).agg(
        F.count("*").alias("n_items"), F.count_if(F.col("answer").isNull()).alias("n_unreadable"), F.count_if(right).alias("n_correct"),
        ratio(F.count_if(right), F.count("*")).alias("accuracy"), ratio(F.count_if(right), F.count("answer")).alias("accuracy_on_readable"),
    )


def answer_positions(answers: DataFrame) -> DataFrame:
    """(position, n): where in the options the read answers stand, from 0."""
    at = (F.array_position("options", F.col("answer")) - 1).cast("long")
    return answers.where(F.col("answer").isNotNull()).groupBy(at.alias("position")).agg(F.count("*").alias("n"))


def frequent_answers(answers: DataFrame, k: int = 5) -> DataFrame:
    """(answer, n): the k answers read most often, ties to the smaller one."""
    return answers.where(F.col("answer").isNotNull()).groupBy("answer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "answer").limit(k)


def margin(level: Column, bed: Column) -> Column:
    """How far an event is over the background (dB); null where either is unknown."""
    return level - bed


def is_rare(event: Column) -> Column:
    return F.coalesce(F.contains(event["source_file"], F.lit("rare_events/")), F.lit(False)) | F.coalesce(event["layer"] == "rare", F.lit(False)) | F.coalesce(event["is_rare"], F.lit(False))


def _item(key: str, *parts: str | Column) -> Column:
    return F.concat_ws("::", F.col(key).cast("string"), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def scene_items(manifests: DataFrame, scenes: DataFrame, key: str = "scenario_id") -> DataFrame:
    """A multiple-choice item per scene of the catalogue: which place is it? The places are a short list."""
    plain = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    listed = one_list(scenes, "scene", "_all")
    known = scenes.select("scene", F.lit(1).alias("_k")).distinct().join(F.broadcast(listed.withColumn("_k", F.lit(1))), "_k").drop("_k")
    rows = manifests.join(known, "scene").withColumn("item_id", _item(key, "scene")).withColumn("gold", plain(F.col("scene")))
    return rows.withColumn("options", options(F.col("item_id"), F.col("gold"), F.transform("_all", plain))).select("item_id", key, "scene", "gold", "options")


def placed(manifests: DataFrame, key: str = "scenario_id") -> DataFrame:
    """(key, scene, bed, rank, event): a row per placed event, ranked from 0."""
    return manifests.select(key, "scene", "bed", F.posexplode("events_placed").alias("rank", "event"))


def sound_items(manifests: DataFrame, pool: DataFrame, key: str = "scenario_id") -> DataFrame:
    """A multiple-choice item per placed event: distractors are of the scene's pool (scene, event), not heard in the scene.

    Scenes that the pool doesn't know and events with fewer than three distractors give none.
    """
    names = pool.groupBy("scene").agg(F.array_sort(F.collect_set(pretty(F.col("event")))).alias("_pool"))
    heard = manifests.withColumn("_heard", F.transform("events_placed", lambda e: pretty(e["event_id"])))
    rows = heard.join(names, "scene").select(key, "scene", "bed", F.array_except("_pool", "_heard").alias("_others"), F.posexplode("events_placed").alias("rank", "event"))
    rows = rows.withColumn("item_id", _item(key, "mcq-sound", F.col("rank"))).withColumn("gold", pretty(F.col("event.event_id")))
    rows = rows.withColumn("options", options(F.col("item_id"), F.col("gold"), F.col("_others"))).where("options IS NOT NULL")
    return rows.select("item_id", key, "scene", F.col("event.start_s").alias("t"), "gold", "options", F.col("event.reaction").alias("reaction"), margin(F.col("event.level_lufs"), F.col("bed")).alias("margin_db"))


def reaction_items(manifests: DataFrame, key: str = "scenario_id") -> DataFrame:
    """An item per placed event with a known reaction: which one is it?"""
    rows = placed(manifests, key).where(F.col("event.reaction").isin(*REACTIONS))
    return rows.select(_item(key, "reaction", F.col("rank")).alias("item_id"), key, "scene", "event.event_id", "event.start_s", margin(F.col("event.level_lufs"), F.col("bed")).alias("margin_db"), F.col("event.reaction").alias("gold"))


def gold_sounds(manifests: DataFrame, key: str = "scenario_id") -> DataFrame:
    """(key, scene, gold): what a summary may mention, as an array of event_id, name, reaction, is_rare, margin_db; scenes without a sound are left out."""
    sound = lambda e: F.struct(e["event_id"].alias("event_id"), pretty(e["event_id"]).alias("name"), e["reaction"].alias("reaction"), is_rare(e).alias("is_rare"), margin(e["level_lufs"], F.col("bed")).alias("margin_db"))
    return manifests.where(F.size("events_placed") > 0).select(key, "scene", F.transform("events_placed", sound).alias("gold"))
