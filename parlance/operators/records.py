"""Canonical records: scenarios from the loose forms in which they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import REACTIONS, event_name

#: Reactions by which somebody takes notice of a sound.
REACTED_TO = ("pivot", "verbal", "behavioral")
EVENT_FIELDS = ("event_id", "reaction", "is_rare", "register", "slot")


def filled(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def subject_of(own: Column, generated: Column) -> Column:
    """A scenario's subject, else the generated one, without blanks around it; empty if there is none."""
    return F.trim(F.coalesce(own, generated, F.lit("")))


def events_of(events: Column) -> Column:
    """Events that have an id, with is_rare, register and slot filled in; an empty array for none."""
    kept = F.filter(events, lambda e: F.coalesce(e["event_id"], F.lit("")) != "")
    plain = lambda e: F.struct(
        e["event_id"].alias("event_id"), e["reaction"].alias("reaction"), F.coalesce(e["is_rare"], F.lit(False)).alias("is_rare"), filled(e["register"]).alias("register"), filled(e["slot"]).alias("slot")
    )
    return F.transform(F.coalesce(kept, F.filter(events, lambda e: F.lit(False)), F.expr("cast(array() as array<struct<event_id:string,reaction:string,is_rare:boolean,register:string,slot:string>>)")), plain)


def speakers_of(speakers: Column, role_a: Column, role_b: Column) -> Column:
    """Both speakers' roles: from `speakers` where it names both, else role_a and role_b."""
    a, b = filled(speakers["A"]), filled(speakers["B"])
    both = a.isNotNull() & b.isNotNull()
    return F.struct(F.when(both, a).otherwise(role_a).alias("A"), F.when(both, b).otherwise(role_b).alias("B"))


def count_of(events: Column, reactions: tuple[str, ...]) -> Column:
    return F.size(F.filter(events, lambda e: F.coalesce(e["reaction"].isin(*reactions), F.lit(False)))).cast("long")


def any_rare(events: Column) -> Column:
    return F.exists(events, lambda e: e["is_rare"])


def normalised(scenarios: DataFrame) -> DataFrame:
    """One canonical row per scenario, with its counts and its stratum.

    scenarios: the columns of sources.tables.SCENARIO. `theme` is a plain title or a JSON object with title and
    description; a template's title and description go before them.
    """
    theme = F.from_json("theme", "title string, description string")
    is_object = F.coalesce(F.trim("theme"), F.lit("")).startswith("{")
    title = F.when(is_object, theme["title"]).otherwise(F.col("theme"))
    rows = scenarios.select(
        "scenario_id", "template_id", "category",
        F.coalesce(filled(F.col("template_title")), title, F.lit("")).alias("theme_title"),
        F.coalesce(filled(F.col("template_description")), F.when(is_object, theme["description"]), F.lit("")).alias("theme_description"),
        title.alias("theme_label"), "scene",
        F.coalesce("role_a", "speakers.A").alias("role_a"), F.coalesce("role_b", "speakers.B").alias("role_b"), "gender_a", "gender_b",
        subject_of(F.col("subject"), F.col("llm_output.subject")).alias("subject"), events_of(F.col("events")).alias("events"),
        F.col("has_rare_event").alias("_rare"), "scenario_idx_in_template", "split",
    )
    e = F.col("events")
    counts = {f"n_{r}": count_of(e, (r,)) for r in REACTIONS}
    rows = rows.withColumns(counts | {"n_events": F.size(e).cast("long"), "n_reacted_to": count_of(e, REACTED_TO), "has_rare_event": F.coalesce("_rare", any_rare(e)), "has_rare": F.coalesce("_rare", F.lit(False)) | any_rare(e)})
    return rows.withColumns({"has_pivot": F.col("n_pivot") > 0, "stratum": F.concat(F.lit("r"), "n_reacted_to")}).drop("_rare")


def restricted(rows: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """Rows of the named splits; all of them where none is named."""
    return rows.where(F.col("split").isin(*splits)) if splits else rows


def distributions(normal: DataFrame) -> DataFrame:
    """(kind, value, n): how finished scenarios spread over compositions, counts, reactions, scenes, relations and events.

    Every scenario gives a short array of (kind, value), which one pre-aggregated count sums up.
    """
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    composition = F.format_string("P%dV%dB%dA%d", *[F.col(f"n_{r}") for r in REACTIONS])
    own = [pair("composition", composition), pair("n_events", F.col("n_events")), pair("scene", F.col("scene")), pair("relation", F.concat_ws(" / ", "role_a", "role_b"))]
    flags = [F.when(F.col("has_pivot"), pair("flag", F.lit("pivot"))), F.when(F.col("has_rare_event"), pair("flag", F.lit("rare")))]
    each = lambda kind, field: F.transform("events", lambda e: pair(kind, e[field]))
    listed = F.concat(F.filter(F.array(*own, *flags), lambda x: x.isNotNull()), each("reaction", "reaction"), each("event", "event_id"))
    return normal.select(F.explode(listed).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def turn_rows(dialogues: DataFrame, key: str, timeline: str = "timeline") -> DataFrame:
    """(key, position, type, speaker, text, event_id): a row per item of a timeline, types mended."""
    rows = dialogues.select(key, F.posexplode(timeline).alias("position", "i")).select(key, "position", "i.*")
    return rows.withColumn("type", item_type(F.col("type"), F.col("speaker"), F.col("text"), F.col("event_id")))


def item_type(declared: Column, speaker: Column, text: Column, event_id: Column) -> Column:
    """The declared type if it is known, else what the fields say: both speaker and text, or an event's id, but not both."""
    said, heard = speaker.isNotNull() & text.isNotNull(), event_id.isNotNull()
    return F.when(F.coalesce(declared.isin("utterance", "event"), F.lit(False)), declared).when(said & ~heard, "utterance").when(heard & ~said, "event").otherwise(declared)


def event_terms(event_id: Column) -> Column:
    """Words of at least four letters of an event's name."""
    return F.filter(F.split(F.lower(event_name(event_id)), r"[_\-\s]+"), lambda w: F.length(w) >= 4)


def flat_templates(themes: DataFrame) -> DataFrame:
    """(template_id, category, theme, index, title, description): a row per template of the themes (category, theme, templates) that have any."""
    rows = themes.where(F.size("templates") > 0).select("category", "theme", F.posexplode("templates").alias("_i", "t"))
    name = F.concat_ws("__", F.coalesce("category", F.lit("")), F.coalesce("theme", F.lit("")), F.lpad((F.col("_i") + 1).cast("string"), 2, "0"))
    full = F.when(F.col("_i") < 99, name).otherwise(F.concat_ws("__", F.coalesce("category", F.lit("")), F.coalesce("theme", F.lit("")), (F.col("_i") + 1).cast("string")))
    return rows.select(F.replace(full, F.lit(" "), F.lit("_")).alias("template_id"), "category", "theme", (F.col("_i") + 1).alias("index"), "t.title", "t.description")
