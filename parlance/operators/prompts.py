"""Texts for models and raters out of records: transcripts, lists of events, options, messages, clues in replies.

Wording comes in as templates. All of it is expressions within the row; only the table of registers is looked up, as
one broadcast map.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import event_name, pretty

#: How the third of a dialogue where an event belongs is put into words.
SLOT_WORDS = {
    "early": "in the FIRST THIRD of the conversation",
    "middle": "in the MIDDLE THIRD of the conversation",
    "late": "in the LAST THIRD of the conversation",
}
#: Most registers that a table may have; it goes to every task as one map.
MOST_REGISTERS = 100_000
_APART = "\x1f"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def filled_in(template: str, **fields: Column) -> Column:
    """`template` with its {names} replaced, nulls by nothing; `{{` and `}}` stand for braces.

    The template is read once, when the plan is made, so braces inside values are left as they are.
    """
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        parts += [F.lit(literal)] * bool(literal) + ([] if name is None else [text_or_empty(fields[name])])
    return F.concat(F.lit(""), *parts)


def messages(system: Column, user: Column) -> Column:
    """The system's and the user's message as an array of (role, content)."""
    said = lambda role, content: F.struct(F.lit(role).alias("role"), text_or_empty(content).alias("content"))
    return F.array(said("system", system), said("user", user))


def bullets(values: Column, indent: int = 2, none: str = "") -> Column:
    """A line for each value that isn't null; `none` for an empty or null array."""
    lines = F.transform(values, lambda v: F.concat(F.lit(" " * indent + "- "), v))
    return F.when(F.size(values) > 0, F.array_join(lines, "\n")).otherwise(none)


def transcript(timeline: Column) -> Column:
    """Lines `speaker: text` and `[SOUND: id]` in the timeline's order; items of other types give none. Null: empty."""
    line = lambda i: (
        F.when(i["type"] == "utterance", F.concat(text_or_empty(i["speaker"]), F.lit(": "), text_or_empty(i["text"])))
        .when(i["type"] == "event", F.concat(F.lit("[SOUND: "), text_or_empty(i["event_id"]), F.lit("]")))
    )
    return F.coalesce(F.array_join(F.transform(timeline, line), "\n"), F.lit(""))


def heard_ids(timeline: Column) -> Column:
    """Distinct ids of a timeline's events, in order of appearance."""
    heard = F.filter(timeline, lambda i: (i["type"] == "event") & (text_or_empty(i["event_id"]) != ""))
    return F.array_distinct(F.transform(heard, lambda i: i["event_id"]))


def pivot_of(events: Column) -> Column:
    """Id of the first event whose reaction is a pivot; null if none."""
    return F.get(F.filter(events, lambda e: F.coalesce(e["reaction"] == "pivot", F.lit(False))), F.lit(0))["event_id"]


#: What an event's line is made of.
BEFORE_EVENT, BEFORE_REACTION, RARE_MARK, PLACE_MARK = "    - ", "  →  ", "  (rare, disruptive)", ("   [PLACEMENT: ", "]")


def with_event_lines(scenarios: DataFrame, registers: DataFrame, move: str, tags: str, events: str = "events", none: str = "    (none)", name: str = "event_lines") -> DataFrame:
    """`scenarios` with `event_lines`: per event its id, reaction, whether it is rare, its place, its register's move and tags.

    registers: (reaction, register, move, required_tags), the first of equal ones by move. `move` and `tags` are templates
    of the lines that follow an event whose register has a move, with {register} and {move}, and with {tags}. Unknown
    registers add no line. More than MOST_REGISTERS raise.
    """
    key = lambda reaction, register: F.concat_ws(_APART, text_or_empty(reaction), text_or_empty(register))
    known = registers.where(text_or_empty(F.col("move")) != "").groupBy(key(F.col("reaction"), F.col("register")).alias("k"))
    known = known.agg(F.min(F.struct("move", F.coalesce("required_tags", F.array().cast("array<string>")).alias("tags"))).alias("v"))
    counted = known.groupBy(F.lit(1).alias("_k")).agg(F.count("*").alias("_n"), F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_moves"))
    moves = F.when(F.col("_n") > MOST_REGISTERS, F.raise_error(F.lit(f"more than {MOST_REGISTERS} registers"))).otherwise(F.col("_moves"))
    place = F.create_map(*[F.lit(x) for pair in SLOT_WORDS.items() for x in pair])

    def lines(e: Column) -> Column:
        found = moves[key(e["reaction"], e["register"])]
        where = F.when(text_or_empty(e["slot"]) != "", place[e["slot"]])
        first = F.concat(F.lit(BEFORE_EVENT), text_or_empty(e["event_id"]), F.lit(BEFORE_REACTION), F.upper(text_or_empty(e["reaction"])), F.when(F.coalesce(e["is_rare"], F.lit(False)), RARE_MARK).otherwise(""), F.coalesce(F.concat(F.lit(PLACE_MARK[0]), where, F.lit(PLACE_MARK[1])), F.lit("")))
        moved = F.when(found["move"].isNotNull(), filled_in(move, register=e["register"], move=found["move"]))
        tagged = F.when(F.size(found["tags"]) > 0, filled_in(tags, tags=F.array_join(found["tags"], ", ")))
        return F.concat_ws("\n", first, moved, tagged)

    rows = scenarios.withColumn("_k", F.lit(1)).join(F.broadcast(counted), "_k", "left")
    block = F.when(F.size(events) > 0, F.array_join(F.transform(events, lines), "\n")).otherwise(none)
    return rows.withColumn(name, block).drop("_k", "_n", "_moves")


def revealed(start: Column, event_id: Column, reveal: Column, none: str, time: str, time_id: str) -> Column:
    """What a prompt tells of a sound: nothing, its time {t}, or its time and its {name}; nothing for one of unknown time.

    {t} has one decimal, halves rounded up.
    """
    said = {"t": F.format_string("%.1f", start), "name": pretty(event_id)}
    return F.when(start.isNull() | (reveal == "none"), none).when(reveal == "time_id", filled_in(time_id, **said)).otherwise(filled_in(time, t=said["t"]))


def clues(reply: Column, scene: Column, event_ids: Column, dialogue: Column, most: int = 4) -> Column:
    """What in a reply suggests that its writer listened: struct of place, sounds and echoed.

    place: the scene's name, if the reply has one of its words of over three letters. sounds: names of events all of whose
    such words it has. echoed: the first `most` of the dialogue's words of six letters and more that it has, sorted.
    """
    low = F.lower(text_or_empty(reply))
    long_words = lambda name: F.filter(F.split(name, "[ \\t\\r\\n]+"), lambda w: F.length(w) > 3)
    has = lambda w: F.contains(low, w)
    place = F.replace(text_or_empty(scene), F.lit("_"), F.lit(" "))
    names = F.transform(F.filter(event_ids, lambda e: e.isNotNull()), lambda e: F.replace(event_name(e), F.lit("_"), F.lit(" ")))
    named = F.filter(names, lambda n: (F.size(long_words(n)) > 0) & F.forall(long_words(n), has))
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(dialogue)), F.lit("([a-z]{6,})"))))
    return F.struct(
        F.when(F.exists(long_words(place), has), place).alias("place"), F.coalesce(named, F.array().cast("array<string>")).alias("sounds"), F.slice(F.filter(words, has), 1, most).alias("echoed"),
    )
