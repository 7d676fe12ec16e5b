"""Levels and distances of placed sounds, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.quota import uniform

#: Levels by layer (LUFS), of the voice and the background, and bounds (dB).
LAYER_LUFS = {"core": -20.0, "supporting": -23.0, "rare": -17.0}
VOICE_LUFS, BACKGROUND_LUFS, JITTER_DB, MOST_OVER_VOICE_DB = -20.0, -32.0, 3.0, 6.0
#: The reference distance (m), bounds of a level's change (dB), and what a distant sound keeps.
REFERENCE_M, LOUDER_DB, QUIETER_DB, OPEN_HZ, EXPONENT, FLOOR_HZ, MOST_WET = 2.0, 4.0, -9.0, 18000.0, 0.6, 3500.0, 0.25
#: Edges of the margins' buckets (dB).
MARGIN_EDGES = (0.0, 6.0, 10.0, 15.0)
#: Near, far (m) of sounds without a profile of their own: rare ones, outdoors, anywhere else.
RARE_RANGE, OUTDOOR_RANGE, DEFAULT_RANGE = (5.0, 60.0), (1.5, 20.0), (1.0, 6.0)
OUTDOOR = ("street_traffic", "public_park", "beach", "construction_site", "rural", "nighttime_nature", "forest_path")


def distance_offset(metres: Column, reference: float = REFERENCE_M, low: float = QUIETER_DB, high: float = LOUDER_DB) -> Column:
    """Level change of a source at a distance, -20 log10(d / reference), within bounds; a millimetre at least."""
    return F.greatest(F.least(-20 * F.log10(F.greatest(metres, F.lit(1e-3)) / max(reference, 1e-3)), F.lit(high)), F.lit(low))


def event_level(layer: Column, metres: Column, floor: Column | None = None) -> Column:
    """A layer's level (an unknown one counts as core), moved by a distance that is known, not below `floor` where one is given."""
    base = F.coalesce(*[F.when(layer == name, F.lit(lufs)) for name, lufs in LAYER_LUFS.items()], F.lit(LAYER_LUFS["core"]))
    level = base + F.coalesce(distance_offset(metres), F.lit(0.0)) * metres.isNotNull().cast("int")
    return level if floor is None else F.greatest(level, floor)


def duck(requested: Column, event: Column, voice: float = VOICE_LUFS, most_over: float = MOST_OVER_VOICE_DB) -> Column:
    """Ducking of the voice (0 or less), limited so that the event stays at most `most_over` above it; unlimited for an event of no level."""
    wanted = F.least(requested, F.lit(0.0))
    return F.when(event.isNull(), wanted).otherwise(F.greatest(wanted, -F.greatest(voice + most_over - event, F.lit(0.0))))


def jittered(u: Column, centre: float = BACKGROUND_LUFS, width: float = JITTER_DB) -> Column:
    """A level around `centre` from a uniform number; `centre` itself for no width."""
    return centre + (2 * u - 1) * width


def lowpass_hz(metres: Column, near: float = REFERENCE_M) -> Column:
    """Cut-off for distant sources, falling with a power of the distance; null within `near`."""
    return F.when(metres > near, F.greatest(OPEN_HZ * F.pow(near / metres, F.lit(EXPONENT)), F.lit(FLOOR_HZ)))


def wet_mix(base: Column, metres: Column, near: float = REFERENCE_M) -> Column:
    """Share of reverberation at a distance, from its share `base` at the reference distance: d^2 / (d^2 + c^2), at most MOST_WET."""
    critical_squared = near * near * (1.0 / base - 1.0)
    d = F.greatest(metres, F.lit(1e-3))
    return F.when(base <= 0, 0.0).when(base >= 1, MOST_WET).otherwise(F.least(d * d / (d * d + critical_squared), F.lit(MOST_WET)))


def with_distance_range(events: DataFrame, profiles: DataFrame, event: str = "event_id", scene: str = "scene") -> DataFrame:
    """`events` with near and far (m) of each event.

    profiles: (event_id, near, far), a table of the catalogue's size. An event's own profile counts first, then that of
    an event of the same leaf name; rare events have profiles of their own only. Then the ranges of rare events,
    of scenes outdoors, and the default.
    """
    leaf = lambda c: F.regexp_replace(c, "^[^/]*/", "")
    own = profiles.select(F.col("event_id").alias("_own"), F.struct("near", "far").alias("_exact"))
    by_leaf = profiles.where(~F.col("event_id").startswith("rare_events/")).groupBy(leaf(F.col("event_id")).alias("_leaf")).agg(F.max_by(F.struct("near", "far"), "event_id").alias("_alike"))
    rows = events.join(own, F.col(event) == F.col("_own"), "left").join(by_leaf, leaf(F.col(event)) == F.col("_leaf"), "left")
    rare = F.col(event).startswith("rare_events/")
    place = F.coalesce(F.nullif(F.col(scene), F.lit("")), F.substring_index(event, "/", 1))
    pair = lambda p: F.struct(F.lit(p[0]).alias("near"), F.lit(p[1]).alias("far"))
    found = F.coalesce(F.col("_exact"), F.when(rare, pair(RARE_RANGE)), F.col("_alike"), F.when(place.isin(*OUTDOOR), pair(OUTDOOR_RANGE)), pair(DEFAULT_RANGE))
    return rows.withColumn("_r", found).withColumn("near", F.col("_r.near")).withColumn("far", F.col("_r.far")).drop("_own", "_exact", "_leaf", "_alike", "_r")


def drawn_distance(near: Column, far: Column, u: Column, bias: float | Column = 1.0) -> Column:
    """A distance in the nearer `bias` part of a range, from a uniform number; a null bias is 1."""
    share = F.least(F.greatest(F.coalesce(bias, F.lit(1.0)), F.lit(0.0)), F.lit(1.0)) if isinstance(bias, Column) else min(1.0, max(0.0, bias))
    return near + (far - near) * share * u


def by_reaction(reaction: Column, biases: dict[str, float]) -> Column:
    """The bias of a reaction's distances; 1 for others and null."""
    return F.coalesce(*[F.when(reaction == r, F.lit(float(b))) for r, b in biases.items()], F.lit(1.0))


#: How far a room's length, width and microphone distance vary between splits.
ROOM_RANGES = ((0.90, 1.10), (0.90, 1.10), (0.75, 1.25))


def room_variation(scene: str, split: str) -> Column:
    """Factors of a scene's room in a split, as array; 1 where there is no split."""
    drawn = [low + (high - low) * uniform(f"room{i}", scene, split) for i, (low, high) in enumerate(ROOM_RANGES)]
    return F.when(F.coalesce(F.col(split), F.lit("")) != "", F.array(*drawn)).otherwise(F.array(*[F.lit(1.0)] * len(ROOM_RANGES)))


def margin_bucket(margin: Column, edges: tuple[float, ...] = MARGIN_EDGES) -> Column:
    """Label of the half-open interval of a margin in dB, rounded to two decimals first."""
    m = F.round(margin, 2)
    cases = [F.when((m >= a) & (m < b), f"{a:g}-{b:g} dB") for a, b in zip(edges, edges[1:])]
    return F.coalesce(*cases, F.when(m >= edges[-1], f"{edges[-1]:g}-inf dB"), F.lit("unknown"))


def tail_pad(duration: Column, window: float = 30.0, least: float = 1.0) -> Column:
    """Seconds to add so that the last window holds either nothing or at least `least` seconds."""
    rest = F.pmod(duration, F.lit(window))
    return F.when((rest > 0) & (rest < least), least - rest).otherwise(0.0)
