"""Placing sounds on the time axis: shifts, scaling and spans, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.quota import uniform
from parlance.operators.timeline import utterances_before


def shifted_turns(turns: DataFrame, key: str, order: str, start: str, end: str, gap: str) -> DataFrame:
    """`turns` with new_start and new_end after a gap is put in behind each turn: times move by the gaps before."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(gap).over(before), F.lit(0.0))
    return turns.withColumn("new_start", F.col(start) + shift).withColumn("new_end", F.col(end) + shift)


def rescaled(turns: DataFrame, key: str, start: str, end: str, audio: str, low: float = 0.85, high: float = 1.25, least: float = 1e-4) -> DataFrame:
    """Times scaled so that the last end is the audio's length, for factors that are plausible."""
    factor = F.try_divide(F.col(audio).cast("double"), F.max(end).over(Window.partitionBy(key)).cast("double"))
    used = F.when(factor.between(low, high) & (F.abs(factor - 1) > least), factor).otherwise(1.0)
    return turns.withColumn("factor", used).withColumn("new_start", F.col(start) * F.col("factor")).withColumn("new_end", F.col(end) * F.col("factor"))


def offset_chunks(chunks: DataFrame, key: str, order: str, duration: str) -> DataFrame:
    """`chunks` with offset: what the chunks before last in all."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum(duration).over(before), F.lit(0.0)))


def sample_span(start: Column, end: Column, total: Column, rate: int = 44_100) -> Column:
    """struct(first, last) of samples in [start, end) seconds, clipped to the signal."""
    clip = lambda t: F.greatest(F.lit(0), F.least(F.floor(t * rate), total)).cast("long")
    return F.struct(clip(start).alias("first"), clip(end).alias("last"))


def spaced_turns(turns: DataFrame, key: str, order: str, start: str, end: str, length: str, low: float, high: float, cut: str | None = None, salt: str = "gap") -> DataFrame:
    """`turns` with a drawn pause of `low` to `high` seconds behind each but the last: gap, new_start and new_end.

    A scene is cut where its turns end (or at `cut`, a better place near there), clipped to its `length`. The first turn then starts at
    0, any other where the one before is cut, moved by all pauses so far; the last ends with the scene. Scenes of one turn, or where an
    end but the last is unknown or the clipped ends fall, stay as they are.
    """
    w, whole = Window.partitionBy(key).orderBy(order), Window.partitionBy(key)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.col(length).cast("double"), F.col(c).cast("double")))
    last = F.lead(order).over(w).isNull()
    rows = turns.withColumn("_last", last).withColumn("_bound", F.when(F.col(end).isNotNull(), clip(end))).withColumn("_cut", F.coalesce(F.col(cut), F.col("_bound")) if cut else F.col("_bound"))
    wrong = ~F.col("_last") & (F.col("_bound").isNull() | F.coalesce(F.col("_bound") < F.lag("_bound").over(w), F.lit(False)))
    rows = rows.withColumn("_stays", (F.max(wrong.cast("int")).over(whole) == 1) | (F.count("*").over(whole) < 2) | ~F.coalesce(F.col(length) > 0, F.lit(False)))
    drawn = low + (max(low, high) - low) * uniform(salt, key, order)
    rows = rows.withColumn("gap", F.when(F.col("_last") | F.col("_stays"), 0.0).otherwise(drawn))
    shift = F.coalesce(F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("_shift", shift).withColumn("_before", F.lag("_cut").over(w))
    rows = rows.withColumn("new_start", F.when(F.col("_stays"), F.col(start)).otherwise(F.coalesce(F.col("_before") + F.col("_shift"), F.lit(0.0))))
    rows = rows.withColumn("new_end", F.when(F.col("_stays"), F.col(end)).when(F.col("_last"), F.col(length) + F.col("_shift")).otherwise(F.col("_cut") + F.col("_shift")))
    return rows.drop("_last", "_bound", "_cut", "_stays", "_shift", "_before")


def with_silence(samples: Column, cuts: Column, gaps: Column) -> Column:
    """`samples` with gaps[i] zeros put in at cuts[i], which rise."""
    none = F.filter(samples, lambda x: F.lit(False))
    pieces = F.transform(cuts, lambda c, i: F.concat(F.slice(samples, F.coalesce(F.get(cuts, i - 1), F.lit(0)) + 1, c - F.coalesce(F.get(cuts, i - 1), F.lit(0))), F.array_repeat(F.lit(0.0), F.get(gaps, i).cast("int"))))
    last = F.coalesce(F.try_element_at(cuts, F.lit(-1)), F.lit(0))
    rest = F.slice(samples, last + 1, F.greatest(F.size(samples) - last, F.lit(0)))
    return F.concat(F.coalesce(F.flatten(pieces), none), rest)


def _level(length: Column, width: float) -> Column:
    """How often `width` has to double until it is at least `length`."""
    return F.greatest(F.ceil(F.log2(length / width)), F.lit(0)).cast("int")


def _binned(rows: DataFrame, start: str, end: str, width: float, others: list[int]) -> DataFrame:
    """A row for each bin that an interval touches at its own level and at those of `others` above: _at (level), _bin, _first, _own."""
    size = lambda level: F.lit(width) * F.pow(F.lit(2.0), level)
    home = F.col("_home")
    above = F.filter(F.array(*[F.lit(x) for x in others]), lambda x: x > home)
    each = rows.withColumn("_home", _level(F.col(end) - F.col(start), width)).withColumn("_at", F.explode(F.concat(F.array(home), above)))
    first, last = F.floor(F.col(start) / size(F.col("_at"))), F.greatest(F.ceil(F.col(end) / size(F.col("_at"))) - 1, F.floor(F.col(start) / size(F.col("_at"))))
    return each.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_at") == home).drop("_home")


def overlaps(left: DataFrame, right: DataFrame, key: str, width: float, spans: tuple[str, str, str, str] = ("a_start", "a_end", "b_start", "b_end")) -> DataFrame:
    """Pairs of rows of one key whose intervals [start, end) share some time, each pair once: all columns of both, and `shared`.

    Columns of the two but `key` differ in name. An interval lies in bins of `width`, doubled until it touches two at most; a
    shorter one also appears in the bins of longer ones' levels. So neither long intervals nor short ones are put into many bins, and
    short ones never meet in wide bins. A pair counts in the later one of the two first bins. A key with many rows is spread over its bins. Null, empty
    and reversed intervals overlap with nothing, and null keys with none.

    Rows of `right` whose key no row of `left` has are put into no bin, and a row only into bins of levels that the other side has. Bins are
    joined by sorting, as asked for: Spark takes rows that are exploded for a small table and would send them through the driver.
    """
    a_start, a_end, b_start, b_end = spans
    known = lambda df, s, e: df.where(F.col(key).isNotNull() & (F.col(e) > F.col(s)))
    left, right = known(left, a_start, a_end), known(right, b_start, b_end)
    levels = lambda df, s, e: sorted(r[0] for r in df.select(_level(F.col(e) - F.col(s), width)).distinct().collect())  # noqa: E731  at most some 60
    of_left, of_right = levels(left, a_start, a_end), levels(right, b_start, b_end)
    if not of_left or not of_right:
        return left.join(right, key).withColumn("shared", F.lit(0.0)).where(F.lit(False))
    binned = _binned(left, a_start, a_end, width, of_right).withColumnsRenamed({"_first": "_first_a"})
    own, guests = (binned.where(c).drop("_own") for c in ("_own", "NOT _own"))
    met = right.join(left.select(key).distinct(), key, "left_semi")
    other = _binned(met, b_start, b_end, width, of_left).withColumnsRenamed({"_first": "_first_b"})
    meet = (F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end)) & (F.col("_bin") == F.greatest("_first_a", "_first_b"))
    pairs = lambda some, others: some.join(others.drop("_own").hint("merge"), [key, "_at", "_bin"]).where(meet)
    found = pairs(own, other.where(F.col("_at").isin(of_left))).unionByName(pairs(guests, other.where("_own")))
    return found.drop("_at", "_bin", "_first_a", "_first_b").withColumn("shared", F.least(a_end, b_end) - F.greatest(a_start, b_start))


#: Where the id of a sound that a person makes starts, and what it may hold.
BEHAVIOURAL_PREFIX = "behavioral/"
BEHAVIOURAL_PARTS = ("cough", "sneeze", "sniff", "throat", "sigh", "breath", "yawn", "laugh", "chuckle", "hiccup", "gulp", "swallow", "clear_throat", "paper_rustling")


def is_behavioural(event_id: Column) -> Column:
    low = F.lower(event_id)
    return F.coalesce(low.startswith(BEHAVIOURAL_PREFIX) | low.rlike("|".join(BEHAVIOURAL_PARTS)), F.lit(False))


def event_placements(items: DataFrame, events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, event_id, layer, after_turn, is_behavioural, reaction): where a timeline's events go and what they are.

    items: (key, order, type, event_id). events: (key, event_id, layer, reaction, behavioural) of each scenario; several
    rows of one event count once: rare before core before supporting, the greatest reaction, behavioural if one says so.
    Unknown events are core. after_turn counts utterances from 0 and is null before the first.
    """
    layer = F.col("layer")
    known = events.groupBy(key, "event_id").agg(
        F.coalesce(F.bool_or(layer == "rare"), F.lit(False)).alias("_rare"), F.coalesce(F.bool_or(layer == "core"), F.lit(False)).alias("_core"),
        F.coalesce(F.bool_or(layer == "supporting"), F.lit(False)).alias("_supporting"), F.max("reaction").alias("reaction"), F.coalesce(F.bool_or("behavioural"), F.lit(False)).alias("_own"),
    )
    kind = F.coalesce("type", F.lit(""))
    placed = utterances_before(items.where(kind.isin("utterance", "event")), key, order, kind == "utterance").where("type = 'event'")
    rows = placed.select(key, order, "event_id", "after_turn").join(known, [key, "event_id"], "left")
    rare = F.coalesce("_rare", F.lit(False)) | F.coalesce(F.col("event_id").startswith("rare_events/"), F.lit(False))
    found = F.when(rare, "rare").when(F.coalesce("_core", F.lit(False)), "core").when(F.coalesce("_supporting", F.lit(False)), "supporting").otherwise("core")
    return rows.select(key, order, "event_id", found.alias("layer"), "after_turn", (F.coalesce("_own", F.lit(False)) | is_behavioural(F.col("event_id"))).alias("is_behavioural"), "reaction")


#: Fields that may say that a sound is made by a person, what they say then, flags that do, and names of an event's id.
NATURE_NAMES = ("reaction", "nature", "event_nature", "event_type", "kind", "role", "category", "class", "label", "sound_type", "behavior", "type")
BEHAVIOURAL_WORDS, BEHAVIOURAL_FLAGS, ID_NAMES = ("behavioral", "behavioural"), ("is_behavioral", "behavioral"), ("event_id", "id", "sound_id")


def says_behavioural(event: Column) -> Column:
    """Whether an event (a variant) says of itself that a person makes it."""
    words_ = [F.lower(F.trim(F.try_variant_get(event, f"$.{n}", "string"))).isin(*BEHAVIOURAL_WORDS) for n in NATURE_NAMES]
    flags = [(F.schema_of_variant(F.try_variant_get(event, f"$.{n}", "variant")) == "BOOLEAN") & F.try_variant_get(event, f"$.{n}", "boolean") for n in BEHAVIOURAL_FLAGS]
    return F.coalesce(F.array_max(F.array(*[F.coalesce(c, F.lit(False)) for c in (*words_, *flags)])), F.lit(False))


def event_id_of(event: Column) -> Column:
    """An event's id, under the first of its names that isn't empty."""
    return F.coalesce(*[F.nullif(F.try_variant_get(event, f"$.{n}", "string"), F.lit("")) for n in ID_NAMES])


def behavioural_ids(record: Column) -> Column:
    """Ids, each once and in order, of the events that a dialogue's record (JSON text) says a person makes.

    Looked at are `events`, every list whose name ends in `elements`, and the timeline's events.
    """
    root = F.try_parse_json(record)
    fields = F.from_json(record, "map<string,string>")
    listed = F.map_values(F.map_filter(fields, lambda k, v: (k.endswith("elements") | (k == "events")) & F.ltrim(v).startswith("[")))
    of = lambda text: F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    own = F.flatten(F.transform(listed, of))
    timeline = F.filter(F.try_variant_get(root, "$.timeline", "array<variant>"), lambda i: F.try_variant_get(i, "$.type", "string") == "event")
    none = F.filter(own, lambda e: F.lit(False))
    every = F.concat(F.coalesce(own, none), F.coalesce(timeline, F.filter(timeline, lambda e: F.lit(False)), none))
    ids = F.filter(F.transform(F.filter(every, says_behavioural), event_id_of), lambda i: i.isNotNull())
    return F.array_sort(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>"))))


def least_gap(least_s: float, margin_s: float, onset_s: float, overlapping: bool) -> float:
    """The shortest pause between turns: where events may overlap speech, one that a margin and an onset fit into."""
    return max(least_s, margin_s + onset_s) if overlapping else least_s


def same_speaker_across(turns: DataFrame, key: str, order: str, speaker: str) -> DataFrame:
    """`turns` with same_across: whether the next turn of the scene is the same speaker's (nulls are alike); true behind the last."""
    following = F.lead(F.struct(speaker)).over(Window.partitionBy(key).orderBy(order))
    return turns.withColumn("same_across", following.isNull() | following[speaker].eqNullSafe(F.col(speaker)))


def not_voiced(events: DataFrame, voices: DataFrame, key: str) -> DataFrame:
    """`events` (key, event_id) that the scene's voice doesn't perform itself, in their place.

    voices: (key, meta), the JSON text written beside a voice; its events_rendered_as_tags lists events with their ids. Without such a list, or
    a readable text, every event is left.
    """
    listed = F.try_variant_get(F.try_parse_json("meta"), "$.events_rendered_as_tags", "array<variant>")
    done = voices.select(F.col(key).alias("_key"), F.explode(listed).alias("_e")).select("_key", F.try_variant_get("_e", "$.event_id", "string").alias("_id")).where("_id <> ''").distinct()
    return events.join(done, (F.col(key) == F.col("_key")) & (F.col("event_id") == F.col("_id")), "left_anti")


def is_synthesized(meta: Column) -> Column:
    """Whether the JSON text beside a voice tells of a voice that was made, not only planned."""
    root = F.try_parse_json(meta)
    planned = F.coalesce(F.try_variant_get(root, "$.dry_run", "boolean"), F.lit(False))
    return F.coalesce(F.ltrim(meta).startswith("{") & root.isNotNull() & ~planned, F.lit(False))
