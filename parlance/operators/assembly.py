"""Finished records: dialogues put together, batch results read back, rows completed from other stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.tags import strengthened
from parlance.functions.text import REACTIONS
from parlance.operators.records import filled, item_type


def finished_timeline(timeline: Column) -> Column:
    """A timeline with types mended and the delivery tags of what is said made stronger."""

    def item(i: Column) -> Column:
        kind = item_type(i["type"], i["speaker"], i["text"], i["event_id"])
        return F.struct(kind.alias("type"), i["speaker"].alias("speaker"), F.when(kind == "utterance", strengthened(i["text"])).otherwise(i["text"]).alias("text"), i["event_id"].alias("event_id"))

    return F.transform(timeline, item)


def final_dialogues(normal: DataFrame, dialogues: DataFrame, key: str = "scenario_id", timeline: str = "timeline") -> DataFrame:
    """One finished row per dialogue: its scenario's fields, the finished timeline, and counts of turns and events.

    normal: records.normalised(), one row per scenario. Dialogues without a scenario give no row. A missing timeline is
    empty; empty splits and genders are null. One join on the key; all counts are within the row.
    """
    fields = ["template_id", "category", "theme_title", "theme_description", "theme_label", "scene", "role_a", "role_b", "subject", "events", "has_rare_event", "scenario_idx_in_template", "n_events", *(f"n_{r}" for r in REACTIONS), "n_reacted_to"]
    rows = normal.select(key, *fields, *[filled(F.col(c)).alias(c) for c in ("split", "gender_a", "gender_b")]).join(dialogues.select(key, finished_timeline(F.col(timeline)).alias("timeline")), key)
    said = lambda who: F.size(F.filter("timeline", lambda i: (i["type"] == "utterance") & who(i))).cast("long")
    rows = rows.withColumn("timeline", F.coalesce("timeline", F.filter("timeline", lambda i: F.lit(False)), F.array().cast("array<struct<type:string,speaker:string,text:string,event_id:string>>")))
    heard = F.size(F.filter("timeline", lambda i: i["type"] == "event")).cast("long")
    return rows.withColumns({"n_turns_total": said(lambda i: F.lit(True)), "n_turns_a": said(lambda i: i["speaker"] == "A"), "n_turns_b": said(lambda i: i["speaker"] == "B"), "n_events_in_timeline": heard})


#: What a finished dialogue takes from its scenario where it hasn't its own.
CARRIED = ("template_id", "category", "theme", "theme_label", "metadata", "split")


def finished_dataset(accepted: DataFrame, normal: DataFrame, key: str = "scenario_id") -> DataFrame:
    """A row per accepted dialogue (key, timeline, CARRIED), with its scenario's scene, roles, subject, events and rare flag.

    normal: records.normalised() and those of CARRIED that it has. Empty values count as none. A theme that is a JSON object gives its title as
    the label where there is no other. Dialogues without a scenario stay, with nothing of one.
    """
    text = lambda df: [c for c in CARRIED if c in df.columns]
    own = accepted.select(key, "timeline", *[F.col(c).alias(f"_own_{c}") for c in text(accepted)])
    other = normal.select(F.col(key).alias("_key"), "scene", "role_a", "role_b", "subject", "events", "has_rare", *[F.col(c).alias(f"_other_{c}") for c in text(normal)])
    rows = own.join(other, F.col(key) == F.col("_key"), "left")
    either = lambda c: F.coalesce(*[filled(F.col(n)) for n in (f"_own_{c}", f"_other_{c}") if n in rows.columns], F.lit(None).cast("string"))
    fields = {c: either(c) for c in CARRIED}
    title = filled(F.get_json_object(F.when(F.ltrim(fields["theme"]).startswith("{"), fields["theme"]), "$.title"))
    fields["theme_label"] = F.coalesce(fields["theme_label"], title)
    return rows.select(key, "scene", "role_a", "role_b", "subject", "events", F.coalesce("has_rare", F.lit(False)).alias("has_rare_event"), "timeline", *[c.alias(n) for n, c in fields.items()])


def batch_results(results: DataFrame, sent: DataFrame, custom: str = "custom_id", key: str = "item_id", longest: int = 400) -> DataFrame:
    """(key, status, reply, note): results of a batch under the ids of the items that were sent.

    results: (custom, kind, reply, error_type, error). sent: (custom, key), one row per custom id; a result whose id nobody
    sent keeps it. status is `batch:kind`, for an error with its type (`unknown` if it has none); note is at most `longest`
    characters of the error; reply is kept of what succeeded.
    """
    kind = F.coalesce("kind", F.lit("unknown"))
    failed = kind == "errored"
    status = F.concat(F.lit("batch:"), kind, F.when(failed, F.concat(F.lit(":"), F.coalesce(filled(F.col("error_type")), F.lit("unknown")))).otherwise(""))
    rows = results.join(sent.select(custom, key), custom, "left")
    return rows.select(F.coalesce(key, custom).alias(key), status.alias("status"), F.when(kind == "succeeded", F.col("reply")).alias("reply"), F.when(failed, F.substring("error", 1, longest)).alias("note"))


def rejected_parameter(message: Column) -> Column:
    """The quoted name behind the first `'param':` of an error's text; null if there is none."""
    found = F.regexp_extract(F.regexp_extract(message, r"(?s)'param':(.*)$", 1), r"""^[ \t\r\n]*(?:'([^']+)'|"([^"]+)")""", 0)
    return filled(F.regexp_replace(F.ltrim(F.regexp_replace(found, r"[\t\r\n]", " ")), r"""^['"]|['"]$""", ""))


def master_levels(rows: DataFrame, manifests: DataFrame, key: str = "scenario_id") -> DataFrame:
    """`rows` with master_input_lufs and master_limiter_gain of the reference manifest, null where it has no such number.

    manifests: (key, processing), one row per key; processing is a JSON object.
    """
    numbers = F.from_json("processing", "master_input_lufs double, master_limiter_gain double")
    return rows.join(manifests.select(key, numbers.alias("_n")).select(key, "_n.*"), key, "left")


def declared_audio(manifests: DataFrame, files: DataFrame, folder: str, key: str = "scenario_id") -> DataFrame:
    """`manifests` (key, audio) with the path to read: the declared one if there is such a file, else <folder>/<key>.wav.

    files: (path), as found in the shared store.
    """
    there = files.select(F.col("path").alias("audio")).distinct().withColumn("_there", F.lit(True))
    usual = F.concat(F.lit(folder.rstrip("/") + "/"), F.col(key).cast("string"), F.lit(".wav"))
    return manifests.join(there, "audio", "left").withColumn("path", F.when(F.col("_there"), F.col("audio")).otherwise(usual)).drop("_there")
