"""Ordered timelines: positions, runs, neighbours, rules and packing.

A timeline is a frame with a scene key, a position, and a boolean column that says whether a row is an
utterance. Windows are over one scene, whose rows are few; no frame is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thirds of a dialogue and how far outside its third an event may stand.
SLOTS, TOLERANCE = ("early", "middle", "late"), 0.10


def _scene(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def utterances_before(df: DataFrame, key: str, order: str, utterance: Column) -> DataFrame:
    """`df` with `seen` (utterances up to and with this row), `total`, and `after_turn`.

    after_turn is the index of the last utterance before the row, null before the first: the as-of join of
    events with utterances, as a running count.
    """
    said = utterance.cast("int")
    prefix = _scene(key, order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("seen", F.coalesce(F.sum(said).over(prefix), F.lit(0)).cast("long"))
    df = df.withColumn("total", F.coalesce(F.sum(said).over(Window.partitionBy(key)), F.lit(0)).cast("long"))
    last = F.col("seen") - said.cast("long")
    return df.withColumn("after_turn", F.when(last > 0, last - 1))


def slot_ok(seen: Column, total: Column, slot: Column) -> Column:
    """Whether an event's position, seen / total, lies in its third of the dialogue, TOLERANCE allowed for.

    Fewer than three utterances or no slot: true.
    """
    band = F.array_position(F.array(*[F.lit(s) for s in SLOTS]), slot) - 1
    position = seen / total
    fits = (position >= band / 3.0 - TOLERANCE) & (position <= (band + 1) / 3.0 + TOLERANCE)
    return F.when((total < len(SLOTS)) | slot.isNull() | (band < 0), True).otherwise(fits)


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, run, value, start, length): maximal runs of equal values (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("_n", F.row_number().over(w))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return marked.groupBy(key, "run").agg(F.first(value).alias(value), F.min("_n").cast("long").alias("start"), F.count("*").alias("length"))


def nearest_same(df: DataFrame, key: str, order: str, same: str, utterance: Column) -> DataFrame:
    """`df` with `anchor`: position of the previous utterance with this row's `same`, else the next one, else any before, else any after."""
    position = F.when(utterance, F.col(order))
    own = Window.partitionBy(key, same).orderBy(order)
    whole = _scene(key, order)
    before, after = lambda w: w.rowsBetween(Window.unboundedPreceding, -1), lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("anchor", F.coalesce(
        F.last(position, ignorenulls=True).over(before(own)), F.first(position, ignorenulls=True).over(after(own)),
        F.last(position, ignorenulls=True).over(before(whole)), F.first(position, ignorenulls=True).over(after(whole)),
    ))


def next_utterance(df: DataFrame, key: str, order: str, utterance: Column, *columns: str) -> DataFrame:
    """`df` with next_<column> of the next utterance after each row."""
    after = _scene(key, order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumns({f"next_{c}": F.first(F.when(utterance, F.struct(c)), ignorenulls=True).over(after)[c] for c in columns})


def midpoint_bounds(df: DataFrame, key: str, order: list[str], start: str, end: str) -> DataFrame:
    """`df` with `bound_start` and `bound_end`: neighbours meet halfway between one's end and the next one's start."""
    w = Window.partitionBy(key).orderBy(*order)
    meet_next = (F.col(end) + F.lead(start).over(w)) / 2
    meet_last = (F.lag(end).over(w) + F.col(start)) / 2
    return df.withColumn("bound_start", F.coalesce(meet_last, F.col(start).cast("double"))).withColumn("bound_end", F.coalesce(meet_next, F.col(end).cast("double")))


def first_gap(df: DataFrame, key: str, order: list[str], time: Column, least: float) -> DataFrame:
    """(key, gap_at, gap): the first gap of at least `least` seconds between neighbours of each group."""
    w = Window.partitionBy(key).orderBy(*order)
    gaps = df.select(key, time.alias("_t"), F.lead(time).over(w).alias("_next"), F.row_number().over(w).alias("_n"))
    found = gaps.where(F.col("_next") - F.col("_t") >= least)
    return found.groupBy(key).agg(F.min_by("_next", "_n").alias("gap_at"), F.min_by(F.col("_next") - F.col("_t"), "_n").alias("gap"))


def first_failure(df: DataFrame, key: str, order: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, reason): of the first row that breaks a rule, the first rule it breaks; null if none does.

    rules: (reason, condition that breaks it), in the order in which they are looked at.
    """
    reason = F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules])
    return df.withColumn("_reason", reason).groupBy(key).agg(F.min_by("_reason", F.when(F.col("_reason").isNotNull(), F.col(order))).alias("reason"))


def pack_in_order(df: DataFrame, key: str, order: str, size: Column, limit: int) -> DataFrame:
    """(key, chunk, first, last, size): greedy packing of a scene's turns, in order, into chunks of at most `limit`.

    A turn longer than the limit is a chunk of its own. A fold over the array of one scene's sizes.
    """
    turns = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), size.cast("long").alias("s")))).alias("t"))
    empty = F.struct(F.expr("cast(array() as array<struct<first:bigint,last:bigint,size:bigint>>)").alias("done"), F.lit(None).cast("struct<first:bigint,last:bigint,size:bigint>").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        alone = F.struct(x["o"].cast("long").alias("first"), x["o"].cast("long").alias("last"), x["s"].alias("size"))
        joined = F.struct(acc["open"]["first"].alias("first"), x["o"].cast("long").alias("last"), (acc["open"]["size"] + x["s"]).alias("size"))
        fits = acc["open"].isNotNull() & (acc["open"]["size"] + x["s"] <= limit)
        return F.struct(
            F.when(fits | acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            F.when(fits, joined).otherwise(alone).alias("open"),
        )

    chunks = turns.select(key, F.aggregate("t", empty, step, lambda acc: F.concat(acc["done"], F.array(acc["open"]))).alias("c"))
    return chunks.select(key, F.posexplode("c").alias("chunk", "x")).select(key, F.col("chunk").cast("long").alias("chunk"), "x.first", "x.last", "x.size")


def most_turns(has_pivot: Column, n_events: Column, base: int = 13) -> Column:
    """Utterances a dialogue may have: more by its events and one if it has a pivot."""
    return F.when(has_pivot, base + n_events + 1).otherwise(base)


ELLIPSES, CLOSERS = ("...", "…"), "[.!?]"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with `value` worked out once for a row and not again for each element of an array that `f` goes through."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def break_offset(text: Column, words: Column, start: Column) -> Column:
    """Seconds from a turn's start to the first word behind its first ellipsis; null without one, or without a word there.

    words: (start, end, off), off being a word's place in the text from 0.
    """
    places = F.filter(F.array(*[F.instr(text, F.lit(m)) for m in ELLIPSES]), lambda p: p > 0)
    behind = once(F.array_min(places), lambda p: F.get(F.filter(words, lambda w: w["off"] > p - 1), F.lit(0)))
    return once(behind, lambda b: F.when(b.isNotNull(), F.greatest(b["start"] - start, F.lit(0.0))))


def pause_offset(text: Column, words: Column, start: Column, least: float = 1.2) -> Column:
    """Seconds from a turn's start to the word behind its first pause of at least `least` seconds inside a sentence."""
    between = lambda a, b: F.regexp_replace(F.substr(text, a["off"] + 1, F.greatest(b["off"] - a["off"], F.lit(0).cast("long"))), r"\.\.\.|…", " ")
    inside = lambda a, b: ~F.coalesce(between(a, b).rlike(CLOSERS), F.lit(False))
    follow = F.transform(words, lambda w, i: F.struct(w.alias("a"), F.get(words, i + 1).alias("b")))
    found = F.get(F.filter(follow, lambda p: p["b"].isNotNull() & (p["b"]["start"] - p["a"]["end"] >= least) & inside(p["a"], p["b"])), F.lit(0))["b"]
    return once(found, lambda b: F.when(b.isNotNull(), F.greatest(b["start"] - start, F.lit(0.0))))


def resume_offset(text: Column, words: Column, start: Column, least: float = 1.2) -> Column:
    """struct(offset, kind) of whichever comes first, a break (of equals it goes first) or a pause; null for neither."""

    def first(x: Column) -> Column:
        told = lambda offset, kind: once(offset, lambda o: F.when(o.isNotNull(), F.struct(o.alias("offset"), F.lit(kind).alias("kind"))))
        return F.array_min(F.array(told(break_offset(x["text"], x["words"], x["start"]), "break"), told(pause_offset(x["text"], x["words"], x["start"], least), "pause")))

    return once(F.struct(text.alias("text"), words.alias("words"), start.alias("start")), first)


def synthesis_plans(turns: DataFrame, key: str, order: str, text: str, limit: int) -> DataFrame:
    """(key, n_inputs, total_chars, n_chunks, chunk_ranges): what a scene's synthesis would send, without sending it; ranges are [first, last + 1)."""
    chunks = pack_in_order(turns, key, order, F.length(text), limit)
    ranges = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "first", "last"))), lambda c: F.array(c["first"], c["last"] + 1))
    planned = chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), ranges.alias("chunk_ranges"))
    return turns.groupBy(key).agg(F.count("*").alias("n_inputs"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("total_chars")).join(planned, key)
