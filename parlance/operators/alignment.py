"""Spoken turns: their words, bounds, sources, voices and levels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import strip_tags
from parlance.operators.quota import uniform
from parlance.operators.timeline import midpoint_bounds

#: What a word of a spoken turn is made of; bounds of a speaker's gain, and the least that counts (dB).
LETTER = "[a-z']"
MOST_GAIN_DB, LEAST_GAIN_DB = 12.0, 0.1
#: Most voices that a pool may have; it goes to every task as one array.
MOST_VOICES = 100_000


def word_starts(said: Column) -> Column:
    """The character each word of a text starts at, from 0, as an array; a null text has none. One pass over the text."""
    word = re.compile(f"{LETTER}+")

    @F.pandas_udf("array<int>")
    def starts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: [m.start() for m in word.finditer(t or "")])

    return starts(said)


def word_table(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, order, position, word, offset): words of each turn without its tags, in lower case, and the character each starts at.

    Within the row: a word starts at a letter that none comes before. Turns without a word, null ones too, give no row.
    """
    said = F.lower(strip_tags(F.col(text)))
    rows = turns.select(key, order, F.regexp_extract_all(said, F.lit(f"({LETTER}+)")).alias("_words"), word_starts(F.coalesce(said, F.lit(""))).alias("_starts"))
    rows = rows.select(key, order, F.posexplode(F.arrays_zip(F.col("_words").alias("word"), F.col("_starts").alias("offset"))).alias("position", "w"))
    return rows.select(key, order, "position", F.col("w.word").alias("word"), F.col("w.offset").alias("offset"))


def turns_from_words(words: DataFrame, lengths: DataFrame, key: str, order: str, start: str = "start", end: str = "end", length: str = "duration") -> DataFrame:
    """(key, order, turn_start, turn_end): bounds of the turns that have words.

    A turn reaches from its first word to its last one; neighbours meet halfway, the first starts at 0 and the last
    ends with the audio, whose length `lengths` holds per key. A scene of unknown length keeps its last word's end.
    """
    turns = words.groupBy(key, order).agg(F.min_by(start, "position").alias("_start"), F.max_by(end, "position").alias("_end"))
    met = midpoint_bounds(turns, key, [order], "_start", "_end").join(lengths.select(key, length), key, "left")
    w = Window.partitionBy(key).orderBy(order)
    first, last = F.lag(order).over(w).isNull(), F.lead(order).over(w).isNull()
    return met.select(key, order, F.when(first, 0.0).otherwise(F.col("bound_start")).alias("turn_start"), F.when(last, F.coalesce(length, "bound_end")).otherwise(F.col("bound_end")).alias("turn_end"))


#: Where an alignment file keeps its turns, if it isn't their list itself, and names of a turn's fields.
TURN_LISTS = ("turns", "turns_meta")
SPEAKER_NAMES = ("speaker", "speaker_id", "spk", "voice", "voice_id", "speaker_label")
START_NAMES = ("t_start_s", "start_s", "start", "t_start", "start_time_seconds")
END_NAMES = ("t_end_s", "end_s", "end", "t_end", "end_time_seconds")


def field(turn: Column, names: tuple[str, ...], kind: str) -> Column:
    """The first of `names` that a turn (a variant) has and that isn't null; null if it isn't of that kind."""
    return F.coalesce(*[F.try_variant_get(turn, f"$.{n}", kind) for n in names])


def read_turns(raw: Column) -> Column:
    """Turns of an alignment file's text as array of (speaker, start, end), whatever form it has; null where it holds none.

    The first list that isn't empty counts: under one of TURN_LISTS, else the root itself. An entry that is no object is a turn
    without fields. Text that isn't JSON holds none.
    """
    root = F.try_parse_json(raw)
    lists = [F.try_variant_get(root, path, "array<variant>") for path in (*(f"$.{n}" for n in TURN_LISTS), "$")]
    first = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    return F.transform(first, lambda t: F.struct(field(t, SPEAKER_NAMES, "string").alias("speaker"), field(t, START_NAMES, "double").alias("start"), field(t, END_NAMES, "double").alias("end")))


def is_timed(turns: Column) -> Column:
    """Whether any turn has a start or an end."""
    return F.coalesce(F.exists(turns, lambda t: t["start"].isNotNull() | t["end"].isNotNull()), F.lit(False))


def by_source(sources: dict[str, DataFrame], key: str, turns: str = "turns") -> DataFrame:
    """(key, source, turns): each scene's turns from the first source that has any.

    One pre-aggregated minimum over all sources; of repeated rows of a source the smallest list counts.
    """
    found = [df.select(key, F.struct(F.lit(i).alias("rank"), F.lit(name).alias("source"), F.col(turns).alias("turns")).alias("s")) for i, (name, df) in enumerate(sources.items())]
    rows = reduce(DataFrame.unionByName, found).where(F.size("s.turns") > 0)
    return rows.groupBy(key).agg(F.min("s").alias("s")).select(key, "s.source", F.col("s.turns").alias(turns))


def _at(voices: Column, u: Column) -> Column:
    return F.get(voices, F.floor(u * F.size(voices)).cast("int"))["voice_id"]


def voices_for(scenes: DataFrame, pool: DataFrame, key: str, salt: str = "voice") -> DataFrame:
    """`scenes` with voice_a and voice_b, drawn by a hash of the key and never the same.

    pool: (voice_id, gender). A voice has its speaker's gender (gender_a, gender_b) where the pool has one, any gender
    otherwise, and wherever one of both genders is unknown. Voices without an id don't count. A pool of fewer than
    two voices, or of more than MOST_VOICES, raises.
    """
    known = pool.where(F.coalesce("voice_id", F.lit("")) != "").select("voice_id", "gender").distinct()
    listed = known.groupBy(F.lit(1).alias("_k")).agg(F.count("*").alias("_n"), F.sort_array(F.collect_list(F.struct("voice_id", "gender"))).alias("_every"))
    rows = scenes.withColumn("_k", F.lit(1)).join(F.broadcast(listed), "_k", "left")
    few_or_many = ~F.coalesce(F.col("_n").between(2, MOST_VOICES), F.lit(False))
    every = F.when(few_or_many, F.raise_error(F.lit("a voice pool has 2 to 100000 voices"))).otherwise(F.col("_every"))
    both = F.col("gender_a").isNotNull() & F.col("gender_b").isNotNull()

    def of(gender: str) -> Column:
        alike = F.filter("_every", lambda v: F.coalesce(v["gender"] == F.col(gender), F.lit(False)))
        return F.when(both & (F.size(alike) > 0), alike).otherwise(F.col("_every"))

    others = lambda voices: F.filter(voices, lambda v: v["voice_id"] != F.col("voice_a"))
    rows = rows.withColumn("_every", every).withColumn("voice_a", _at(of("gender_a"), uniform(salt, key)))
    rest = F.when(F.size(others(of("gender_b"))) > 0, others(of("gender_b"))).otherwise(others(F.col("_every")))
    return rows.withColumn("voice_b", _at(rest, uniform(f"{salt} b", key))).drop("_k", "_n", "_every")


def speaker_gains(parts: DataFrame, key: str, speaker: str, energy: str, samples: str) -> DataFrame:
    """(key, speaker, level, gain) in dB: what brings each speaker to the mean of the scene's speakers.

    parts: energy (sum of squares) and number of samples of each stretch of speech, summed before any shuffle. Gains stay
    within MOST_GAIN_DB; below LEAST_GAIN_DB, and for one speaker alone, they are 0. Stretches without speaker or samples don't count.
    """
    sums = parts.where(F.col(speaker).isNotNull() & (F.col(samples) > 0)).groupBy(key, speaker).agg((F.sum(energy) / F.sum(samples)).alias("_mean"))
    level = 20 * F.log10(F.sqrt(F.col("_mean") + 1e-12) + 1e-12)
    off = F.avg("level").over(Window.partitionBy(key)) - F.col("level")
    gain = F.when(F.abs(off) < LEAST_GAIN_DB, 0.0).otherwise(F.greatest(F.least(off, F.lit(MOST_GAIN_DB)), F.lit(-MOST_GAIN_DB)))
    return sums.withColumn("level", level).withColumn("gain", gain).drop("_mean")
