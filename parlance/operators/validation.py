"""Validation of generated timelines: one reason per dialogue, the first rule that it breaks.

Items are rows (key, position, type, speaker, text, event_id), expected events rows (key, event_id, reaction, slot,
tags). All rules are conditions on rows, windows within one dialogue, or joins on its key; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators.records import event_terms
from parlance.operators.timeline import most_turns, slot_ok

#: Turns of a dialogue, words of a turn, turns of one speaker in a row, turns after a pivot.
LEAST_TURNS, MOST_TURNS, MOST_WORDS, MOST_IN_A_ROW, LEAST_AFTER_PIVOT = 8, 13, 60, 3, 4
QUOTES = r"""["'”’)\]]*\s*$"""
#: A sentence's end, and what only looks like one: dots in a row, abbreviations, acronyms, numbers.
SENTENCE_END = "[.!?]" + QUOTES
NO_SENTENCE_END = r"(?:\.\.|…|\b(?:Mr|Mrs|Ms|Dr|Prof|St|Sgt|Lt|vs|etc)|\b[A-Z](?:\.[A-Z])*|\d)\." + QUOTES


def item_failures(items: DataFrame, expected: DataFrame, key: str, most_words: int = MOST_WORDS) -> DataFrame:
    """(key, position, reason) of the first item of each dialogue that breaks a rule of its own."""
    known = expected.select(key, "event_id").distinct().withColumn("_known", F.lit(True))
    said = F.col("type") == "utterance"
    turns = Window.partitionBy(key, F.coalesce(said, F.lit(False))).orderBy("position")
    in_a_row = F.lit(True)
    for back in range(1, MOST_IN_A_ROW):
        in_a_row &= F.coalesce(F.lag("speaker", back).over(turns) == F.col("speaker"), F.lit(False))
    spoken, own = T.strip_tags(F.col("text")), F.trim(F.coalesce("text", F.lit("")))
    reason = F.when(said, F.coalesce(
        F.when(~F.coalesce(F.col("speaker").isin("A", "B"), F.lit(False)), "invalid speaker"),
        F.when(own == "", "empty text"), T.first_forbidden(own), F.when(spoken == "", "no speech"),
        F.when(F.size(T.words(spoken)) > most_words, "too long"), F.when(in_a_row, "same speaker in a row"),
    )).when(F.col("type") == "event", F.when(F.coalesce("event_id", F.lit("")) == "", "missing event_id").when(F.col("_known").isNull(), "unexpected event_id")).otherwise("invalid type")
    marked = items.join(known, [key, "event_id"], "left").select(key, "position", reason.alias("reason"))
    return marked.where("reason IS NOT NULL").groupBy(key).agg(F.min("position").alias("position"), F.min_by("reason", "position").alias("reason"))


def names_an_event(items: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, position, event_id): utterances that hold at least two words of an expected event's name."""
    terms = expected.select(key, "event_id", event_terms(F.col("event_id")).alias("terms")).where("size(terms) >= 2")
    said = items.where("type = 'utterance'").select(key, "position", F.lower(T.strip_tags(F.coalesce("text", F.lit("")))).alias("said"))
    held = lambda t: F.regexp_count(F.col("said"), F.concat(F.lit(r"(^|[^a-z0-9_])\Q"), t, F.lit(r"\E($|[^a-z0-9_])"))) > 0
    return said.join(terms, key).where(F.size(F.filter("terms", held)) >= 2).select(key, "position", "event_id")


def misplaced(items: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, position, event_id): events outside their slot's third of the dialogue."""
    w = Window.partitionBy(key)
    said = (F.col("type") == "utterance").cast("int")
    rows = items.withColumn("seen", F.sum(said).over(w.orderBy("position"))).withColumn("total", F.sum(said).over(w))
    slots = expected.where("slot <> ''").select(key, "event_id", "slot")
    return rows.where("type = 'event'").join(slots, [key, "event_id"]).where(~slot_ok(F.col("seen"), F.col("total"), F.col("slot"))).select(key, "position", "event_id")


def ends_a_sentence(fragment: Column) -> Column:
    return fragment.rlike(SENTENCE_END) & ~fragment.rlike(NO_SENTENCE_END)


def tag_fault(said: Column, tags: Column) -> Column:
    """What is wrong with a reacting turn that must carry one of `tags` inside a sentence; null if nothing is."""
    low = F.lower(F.coalesce(said, F.lit("")))
    found = F.array_min(F.transform(F.filter(tags, lambda t: F.instr(low, F.lower(t)) > 0), lambda t: F.struct(F.instr(low, F.lower(t)).alias("at"), t.alias("tag"))))
    before, after = F.substring(said, F.lit(1), found["at"] - 1), F.substr(said, found["at"] + F.length(found["tag"]))
    clean_before, clean_after = T.strip_tags(before), T.strip_tags(after)
    letters = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), 0)
    last, first = F.try_element_at(letters(clean_before), F.lit(-1)), F.get(letters(clean_after), F.lit(0))
    return (
        F.when(found.isNull(), "tag missing").when(clean_before == "", "tag opens the turn").when(clean_after == "", "tag ends the turn")
        .when(ends_a_sentence(before), "tag after a sentence").when(clean_before.rlike(r"(\.\.\.|…)$"), "tag after an ellipsis").when(last == first, "tag between equal words")
    )


def tag_faults(items: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, position, event_id, fault): placed events whose register requires tags; fault is null where they are right."""
    after = Window.partitionBy(key).orderBy("position").rowsBetween(1, Window.unboundedFollowing)
    said = F.first(F.when(F.col("type") == "utterance", F.struct("text")), ignorenulls=True).over(after)["text"]
    required = expected.where("size(tags) > 0").select(key, "event_id", "tags")
    rows = items.withColumn("_next", said).where("type = 'event'").join(required, [key, "event_id"])
    return rows.select(key, "position", "event_id", tag_fault(F.col("_next"), F.col("tags")).alias("fault"))


def delivery_confirmed(items: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, event_id, confirmed): whether an event's required tags, of which there are some, stand right everywhere."""
    return tag_faults(items, expected, key).groupBy(key, "event_id").agg((F.count("fault") == 0).alias("confirmed"))


def validated(dialogues: DataFrame, items: DataFrame, expected: DataFrame, key: str, least: int = LEAST_TURNS, most: int = MOST_TURNS, most_words: int = MOST_WORDS) -> DataFrame:
    """(key, valid, reason, position) for every row of `dialogues` (key): reason and position are null for valid ones."""
    said, heard = F.col("type") == "utterance", F.col("type") == "event"
    after = Window.partitionBy(key).orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, -1)
    wanted = expected.groupBy(key).agg(F.count("*").alias("n_expected"), F.collect_set("event_id").alias("ids"), F.min_by("event_id", F.when(F.col("reaction") == "pivot", 0)).alias("pivot"), F.max((F.col("reaction") == "pivot").cast("int")).alias("has_pivot"))
    pivots = expected.where("reaction = 'pivot'").select(key, "event_id").distinct().withColumn("_pivot", F.lit(True))
    rows = items.withColumn("_left", F.coalesce(F.count_if(said).over(after), F.lit(0))).join(pivots, [key, "event_id"], "left")
    seen = rows.groupBy(key).agg(
        F.count("*").alias("n_items"), F.count_if(said).alias("n_turns"), F.count_if(heard).alias("n_events"), F.collect_set(F.when(heard, F.col("event_id"))).alias("placed"),
        F.count_distinct(F.when(said, F.col("speaker"))).alias("n_speakers"), F.min_by("_left", F.when(heard & F.col("_pivot"), F.col("position"))).alias("left_after_pivot"),
    )
    own = item_failures(items, expected, key, most_words)
    slots = misplaced(items, expected, key).groupBy(key).agg(F.min("position").alias("slot_at"))
    names = names_an_event(items, expected, key).groupBy(key).agg(F.min("position").alias("named_at"))
    tags = tag_faults(items, expected, key).where("fault IS NOT NULL").groupBy(key).agg(F.min("position").alias("tag_at"), F.min_by("fault", "position").alias("fault"))
    out = dialogues.select(key)
    for part in (seen, wanted, own, slots, names, tags):
        out = out.join(part, key, "left")
    none = F.array().cast("array<string>")
    n_expected = F.coalesce("n_expected", F.lit(0))
    limit = most_turns(F.coalesce("has_pivot", F.lit(0)) == 1, n_expected, most)
    late = [
        ("too few turns", F.col("n_turns") < least, None), ("too many turns", F.col("n_turns") > limit, None),
        ("inconsistent events", F.size(F.array_except(F.coalesce("ids", none), "placed")) > 0, None), ("duplicated events", F.col("n_events") != n_expected, None),
        ("pivot too late", F.col("left_after_pivot") < LEAST_AFTER_PIVOT, None), ("event outside its slot", F.col("slot_at").isNotNull(), "slot_at"),
        ("names the event", F.col("named_at").isNotNull(), "named_at"), (None, F.col("fault").isNotNull(), "tag_at"), ("missing speakers", F.col("n_speakers") != 2, None),
    ]
    found = lambda reason, at: F.struct(reason.alias("reason"), at.cast("long").alias("position"))
    nowhere = F.lit(None).cast("long")
    first = F.coalesce(
        F.when(F.col("n_items").isNull(), found(F.lit("empty timeline"), nowhere)), F.when(F.col("reason").isNotNull(), found(F.col("reason"), F.col("position"))),
        *[F.when(broken, found(F.lit(reason) if reason else F.col("fault"), F.col(at) if at else nowhere)) for reason, broken, at in late],
    )
    return out.select(key, first.alias("x")).select(key, F.col("x").isNull().alias("valid"), "x.reason", "x.position")


def template_faults(templates: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    """(key, reason, position) per theme: why its generated templates can't be used; null if they can.

    templates: key, order, title, description. A theme has n templates, each with a title, which no earlier one of the
    theme has but for case and punctuation at its ends, and a description of at least four words.
    """
    title, told = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("description", F.lit("")))
    plain = F.regexp_replace(F.lower(title), r"^[ .,\-—–]+|[ .,\-—–]+$", "")
    again = F.row_number().over(Window.partitionBy(key, plain).orderBy(order)) > 1
    reason = F.when(title == "", "empty title").when(told == "", "empty description").when(F.size(T.words(told)) < 4, "description too short").when(again, "duplicate title")
    found = templates.withColumn("_r", reason).groupBy(key).agg(F.count("*").alias("_n"), F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col(order))).alias("reason"), F.min(F.when(F.col("_r").isNotNull(), F.col(order))).alias("position"))
    count = F.col("_n") != n
    return found.select(key, F.when(count, "wrong count").otherwise(F.col("reason")).alias("reason"), F.when(~count, F.col("position")).alias("position"))
