"""Allocation of scenarios: exact quotas, dealt out in an order that hashes give.

Every sequence has as many places as there are scenarios; its values come by quota, its order from a hash of (salt, value, number), so that
none is drawn on the driver. Sequences are kept as blocks, an array of small numbers for BLOCK scenarios that follow each other: only these
arrays and the templates are shuffled, and what a scenario holds is worked out in its own row.

Blocks are joined with templates by sorting, as asked for: Spark takes a few rows that are exploded into many for a small
table and would send them all through the driver.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators import quota
from parlance.operators.quota import compositions, even_quota, hash_order, largest_remainder, uniform
from parlance.operators.timeline import SLOTS
from parlance.session import kept, scratch

#: Scenarios of a template, share of rare events, voices of the two speakers.
PER_TEMPLATE, RARE_RATE = 10, 0.05
GENDER_PAIRS = (("F", "F"), ("F", "M"), ("M", "F"), ("M", "M"))
KINDS = ("pivot", "verbal", "behavioral", "ambient")
#: Units of a quota or scenarios that a task orders at most; units are made in runs of RUN. Places of a block.
UNITS, RUN, BLOCK = 250_000, 1 << 14, 1 << 12


def parse_boosts(spec: str | None) -> dict[str, float]:
    """Factors from `class=factor,...`."""
    parts = [chunk.split("=", 1) for chunk in (spec or "").split(",") if chunk.strip()]
    if any(len(p) != 2 for p in parts):
        raise ValueError(f"expected class=factor, got {spec!r}")
    return {name.strip(): float(factor) for name, factor in parts}


def composition_weight(boosts: dict[str, float]) -> Column:
    """The product of factor^count over the classes."""
    unknown = set(boosts) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown classes {sorted(unknown)}")
    weight = F.lit(1.0)
    for kind, factor in boosts.items():
        weight = weight * F.pow(F.lit(float(factor)), F.col(kind))
    return weight


def packed(parts: list[tuple[str, DataFrame]], n: int) -> tuple[list[DataFrame], DataFrame]:
    """The values of each part, numbered by _i0, _i1, ..., and its sequence in blocks: (_block, _v0, _v1, ...), arrays of these numbers by place.

    parts: a salt and values (quota, ...) of each; n: the sum of its quotas. A unit of quota is shuffled as its value's number and its own, to one
    of many ranges of hashes, where it is ordered by the whole hash; a range's order is kept as one array. Places follow from the sizes of the ranges before.
    """
    each = []
    for k, (salt, rows) in enumerate(parts):
        names = [c for c in rows.columns if c != "quota"]
        number = F.row_number().over(Window.orderBy(*names)) - 1  # a catalogue
        stem = F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in names])
        each.append(rows.where("quota > 0").select(F.lit(k).alias("_q"), number.alias("_i"), stem.alias("_stem"), "quota", F.struct(*names).alias(f"_p{k}")))
    listed = kept(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each), "values")
    values = [listed.where(F.col("_q") == k).select(F.col("_i").alias(f"_i{k}"), f"_p{k}.*") for k in range(len(parts))]
    total, ranges = n * len(parts), -(-max(n, 1) // BLOCK)

    runs = listed.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1, F.lit(RUN).cast("long"))))
    runs = runs.repartition(-(-total // (4 * UNITS))) if total > UNITS else runs
    units = runs.withColumn("_u", F.explode(F.sequence("_run", F.least(F.col("_run") + RUN, F.col("quota")) - 1)))
    by_hash = F.sha1(F.concat_ws("|", "_stem", F.col("_u").cast("string")).cast("binary"))
    share = F.conv(F.substring(by_hash, 1, 8), 16, 10).cast("double") / 4294967296.0
    units = units.select("_q", "_i", "_u", F.floor(share * ranges).cast("int").alias("_b"))
    units = units.repartition(-(-total // UNITS), "_q", "_b") if total > UNITS else units.repartition("_q", "_b")
    units = units.join(F.broadcast(listed.select("_q", "_i", "_stem")), ["_q", "_i"])  # the catalogues
    ordered = units.groupBy("_q", "_b").agg(F.sort_array(F.collect_list(F.struct(by_hash.alias("h"), "_i"))).alias("_o"))
    ordered = kept(ordered.select("_q", "_b", F.size("_o").alias("_n"), F.col("_o._i").alias("_v")), "sequences")

    upto = Window.partitionBy("_q").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = ordered.select("_q", "_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    slices = ordered.join(starts, ["_q", "_b"], "left").withColumn("_block", F.explode(F.sequence(F.floor(F.col("_start") / BLOCK), F.floor((F.col("_start") + F.col("_n") - 1) / BLOCK))))
    at, end = F.greatest("_start", F.col("_block") * BLOCK), F.least(F.col("_start") + F.col("_n"), (F.col("_block") + 1) * BLOCK)
    cut = F.slice("_v", (at - F.col("_start") + 1).cast("int"), (end - at).cast("int"))
    blocks = slices.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("_q", at.alias("at"), cut.alias("v")))).alias("_s"))
    of = lambda k: F.flatten(F.filter("_s", lambda x: x["_q"] == k)["v"])
    return values, kept(blocks.select("_block", *[of(k).alias(f"_v{k}") for k in range(len(parts))]), "blocks")


def unpacked(values: DataFrame, blocks: DataFrame, k: int = 0) -> DataFrame:
    """The k-th of packed() sequences as rows (local, ...)."""
    rows = blocks.select((F.col("_block") * BLOCK).alias("_first"), F.posexplode(f"_v{k}").alias("_p", f"_i{k}"))
    return rows.join(F.broadcast(values), f"_i{k}").select((F.col("_first") + F.col("_p")).alias("local"), *[c for c in values.columns if c != f"_i{k}"])


def dealt(values: DataFrame, salt: str, n: int) -> DataFrame:
    """`values` (quota, ...) as a sequence: a row (local, ...) per unit of quota, in hash order. n: the sum of the quotas."""
    (numbered,), blocks = packed([(salt, values)], n)
    return unpacked(numbered, blocks)


def composition_values(spark: SparkSession, n: int, boosts: dict[str, float] | None = None, strategy: str = "compositions") -> DataFrame:
    """(composition, pivot, verbal, behavioral, ambient, quota): n evenly over compositions, by boosts, or first evenly over counts of events."""
    every = compositions(spark).withColumn("total", F.lit(n).cast("long"))
    if strategy == "compositions":
        shared = largest_remainder(every.withColumn("w", composition_weight(boosts or {})), "total", "w", "position")
    elif boosts:
        raise ValueError("boosts go with the strategy 'compositions' only")
    elif strategy == "counts":
        every = every.withColumn("events", F.expr("pivot + verbal + behavioral + ambient"))
        counts = every.select("events", "total").distinct().withColumn("i", F.dense_rank().over(Window.orderBy("events")) - 1)  # a handful of rows
        k = counts.count()
        per_count = counts.select("events", even_quota(F.col("total"), k, F.col("i")).alias("total"))
        own = every.drop("total").join(F.broadcast(per_count), "events")
        parts = F.count("*").over(Window.partitionBy("events"))
        rank = F.row_number().over(Window.partitionBy("events").orderBy("position")) - 1
        shared = own.withColumn("quota", (F.floor(F.col("total") / parts) + (rank < F.col("total") % parts).cast("int")).cast("long"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return shared.select("composition", *KINDS, "quota")


def composition_sequence(spark: SparkSession, n: int, boosts: dict[str, float] | None = None, strategy: str = "compositions", salt: str = "composition") -> DataFrame:
    """(local, composition, pivot, verbal, behavioral, ambient): composition_values(), dealt out."""
    return dealt(composition_values(spark, n, boosts, strategy), salt, n)


def even_values(values: DataFrame, order: str, n: int) -> DataFrame:
    """(..., quota): the rows of a short table, each as often as the others, the first ones once more for the remainder."""
    k = F.count("*").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.orderBy(order)) - 1  # a catalogue's scenes or relations
    return values.withColumn("quota", even_quota(F.lit(n), k, place))


def gender_values(spark: SparkSession, n: int) -> DataFrame:
    pairs = spark.createDataFrame([(i, *pair) for i, pair in enumerate(GENDER_PAIRS)], "_i int, gender_a string, gender_b string")
    return even_values(pairs.withColumnRenamed("_i", "_pair"), "_pair", n)


def relation_values(relations: DataFrame, n: int) -> DataFrame:
    """(_a, _b2, _o, quota): relations evenly, before they are turned."""
    return even_values(relations.select(F.col("role_a").alias("_a"), F.col("role_b").alias("_b2"), F.concat_ws("|", "role_a", "role_b").alias("_o")), "_o", n)


def turned(rows: DataFrame, salt: str = "relation") -> DataFrame:
    """`rows` (local, _a, _b2, _o, ...) with role_a and role_b: each scenario's relation either way round, by a hash."""
    back = uniform(f"{salt}-turn", "local") < 0.5
    return rows.withColumn("role_a", F.when(back, F.col("_b2")).otherwise(F.col("_a"))).withColumn("role_b", F.when(back, F.col("_a")).otherwise(F.col("_b2"))).drop("_a", "_b2", "_o")


def rare_flag(comps: DataFrame, n: int, rate: float = RARE_RATE, salt: str = "rare") -> Column:
    """Whether a scenario (local, pivot) of `comps` has a rare event: round(n x rate) of those with a pivot, or all if they are fewer, by smallest hash.

    The last hash that is taken is found by counts of its first four characters, so that no scenario is shuffled.
    """
    most, eligible = round(n * rate), F.col("pivot") == 1
    hashed = comps.where(eligible).select("local", hash_order(salt, "local").alias("h")).withColumn("_p", F.substring("h", 1, 4))
    upto = F.sum("n").over(Window.orderBy("_p"))  # 65,536 rows at most
    last = hashed.groupBy("_p").agg(F.count("*").alias("n")).withColumn("upto", upto).where(F.col("upto") >= most).orderBy("_p").first() if most > 0 else None
    if last is None:
        return F.coalesce(eligible & F.lit(most > 0), F.lit(False))
    bound = hashed.where(F.col("_p") == last["_p"]).orderBy("h", "local").offset(most - last["upto"] + last["n"] - 1).first()
    h = hash_order(salt, "local")
    return F.coalesce(eligible & ((h < bound["h"]) | ((h == bound["h"]) & (F.col("local") <= bound["local"]))), F.lit(False))


def with_rare_flags(comps: DataFrame, n: int, rate: float = RARE_RATE, salt: str = "rare") -> DataFrame:
    """`comps` with has_rare_event, see rare_flag()."""
    return comps.withColumn("has_rare_event", rare_flag(comps, n, rate, salt))


def todos(templates: DataFrame, order: str, key: str, scenes: DataFrame, relations: DataFrame, boosts: dict[str, float] | None = None, per_template: int = PER_TEMPLATE, lot: str = "") -> DataFrame:
    """A row per scenario: template, its number there, composition, rare flag, scene, roles and voices; and its place `local`, and the `_block` of that.

    templates are numbered in `order`; each has `per_template` scenarios. `lot` names a split, whose sequences are its own.
    """
    spark = templates.sparkSession
    n = templates.count() * per_template
    whole = isinstance(templates.schema[order].dataType, T.IntegralType)
    ranges = quota.value_ranges(templates, order, -(-n // UNITS)) if whole and n > UNITS else None
    numbered = quota.ranked(templates.withColumn("_one", F.lit(0)), ["_one"], [order], ranges).withColumn("_from", F.col("rank") * per_template)
    numbered = kept(numbered.drop("_one", "rank", "n"), "templates")
    made = [composition_values(spark, n, boosts), even_values(scenes, scenes.columns[0], n), relation_values(relations, n), gender_values(spark, n)]
    values, blocks = packed([(f"{salt}{lot}", rows) for salt, rows in zip(("composition", "scene", "relation", "gender"), made)], n)
    rare = rare_flag(unpacked(values[0], blocks), n, salt=f"rare{lot}")

    pieces = numbered.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / BLOCK), F.floor((F.col("_from") + per_template - 1) / BLOCK))))
    tasks = max(-(-n // UNITS), int(spark.conf.get("spark.sql.shuffle.partitions")))  # a given number, as blocks are small until they are taken apart
    pieces, blocks = (df.repartition(tasks, "_block") for df in (pieces, blocks))
    rows = pieces.join(blocks.hint("merge"), "_block")
    first, behind = F.col("_block") * BLOCK, F.col("_from") + per_template
    rows = rows.withColumn("local", F.explode(F.sequence(F.greatest("_from", first), F.least(behind, first + BLOCK) - 1))).withColumn("s", (F.col("local") - F.col("_from") + 1).cast("int"))
    numbers = [F.get(f"_v{k}", (F.col("local") - first).cast("int")).alias(f"_i{k}") for k in range(len(values))]
    rows = rows.select("_block", "local", *templates.columns, "s", F.format_string("%s__s%02d", F.col(key).cast("string"), F.col("s")).alias("scenario_id"), *numbers)
    for k, listed in enumerate(values):
        rows = rows.join(F.broadcast(listed), f"_i{k}").drop(f"_i{k}")  # a catalogue
    return turned(rows.drop("_pair"), f"relation{lot}").withColumn("has_rare_event", rare).withColumnRenamed("s", "scenario_idx_in_template")


def reaction_targets(comps: DataFrame) -> DataFrame:
    """(reaction, share) of all events of the compositions."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("reaction"), F.col(k).cast("long").alias("n")) for k in KINDS]))
    counts = comps.select(kinds.alias("x")).groupBy("x.reaction").agg(F.sum("x.n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # four rows
    return counts.select("reaction", F.try_divide("n", total).alias("share")).where("share IS NOT NULL")


def drawn_places(n: Column, size: Column, salt: str, *columns: str) -> Column:
    """`n` different places below `size`, as an array, drawn one after the other by hashes; never more than `size`."""
    hashed = lambda j: F.xxhash64(F.lit(salt), *columns, j)

    def draw(acc: Column, j: Column) -> Column:
        """The j-th of the places that are left, counted past those taken, which are kept in order."""
        left = F.pmod(hashed(j), size - j)
        found = F.aggregate(acc["taken"], left, lambda x, t: F.when(x >= t, x + 1).otherwise(x))
        return F.struct(F.sort_array(F.concat(acc["taken"], F.array(found))).alias("taken"), F.concat(acc["places"], F.array(found)).alias("places"))

    none = F.array().cast("array<bigint>")
    turns = F.when(F.least(n, size) > 0, F.sequence(F.lit(0).cast("long"), F.least(n, size).cast("long") - 1)).otherwise(none)
    return F.aggregate(turns, F.struct(none.alias("taken"), none.alias("places")), draw, lambda acc: acc["places"])


def short_pools(wanted: DataFrame, pool: DataFrame, rare: DataFrame) -> DataFrame:
    """(scene, n, size, n_rare, wrong): scenes whose events don't suffice for what a scenario of theirs wants, or that have a wrong one.

    wanted: (scene, n, has_rare_event, wrong), n of them ordinary.
    """
    most = wanted.groupBy("scene").agg(F.max("n").alias("n"), F.bool_or("has_rare_event").alias("_r"), F.bool_or("wrong").alias("wrong"))
    sizes = pool.groupBy("scene").agg(F.count_distinct("event_id").alias("size"))
    rares = rare.groupBy("scene").agg(F.count_distinct("event_id").alias("n_rare"))
    rows = most.join(sizes, "scene", "left").join(rares, "scene", "left").fillna(0, ["size", "n_rare"])
    return rows.where("wrong OR n > size OR (_r AND n_rare = 0)").drop("_r")


def with_drawn(rows: DataFrame, events: DataFrame, n: Column, salt: str, most: int, name: str) -> DataFrame:
    """`rows` (scenario_id, scene, ...) with `name`: an array of `n` events (`most` at most) of the scenario's scene, none twice.

    Scenarios are the left side of left joins, so that the catalogue alone is ever broadcast: a row per scene with its size, and one with its events.
    An event is taken from its place by the join, so that no scenario's row ever holds a scene's events.
    """
    listed = events.groupBy("scene").agg(F.sort_array(F.collect_set("event_id")).alias("_pool"))
    placed = rows.join(F.broadcast(listed.select("scene", F.size("_pool").alias("_size"))), "scene", "left").withColumn("_places", drawn_places(n, F.coalesce("_size", F.lit(0)), salt, "scenario_id"))
    one = lambda i: F.get("_pool", F.get("_places", F.lit(i)).cast("int"))
    found = F.slice(F.array(*[one(i) for i in range(most)]).cast("array<string>"), 1, F.size("_places"))
    return placed.join(F.broadcast(listed), "scene", "left").withColumn(name, found).drop("_size", "_pool", "_places")


def drawn_events(some: DataFrame, events: DataFrame, n: Column, salt: str) -> DataFrame:
    """(scenario_id, i, event_id): `n` events of its scene for every scenario of `some` (scenario_id, scene, ...), none twice."""
    most = some.agg(F.max(n)).first()[0] or 0
    return with_drawn(some, events, n, salt, most, "_e").select("scenario_id", F.posexplode("_e").alias("i", "event_id"))


def scenario_draws(rows: DataFrame, pool: DataFrame, rare: DataFrame, salt: str = "event") -> DataFrame:
    """(scenario_id, n, events, slots, rare_event, before): ordinary events drawn for every scenario, none twice, and the reactions that wait for them.

    rows: todos(); pool and rare: (scene, event_id). A rare event takes the pivot's place where the scenario has one. Places in a scene's
    pool are drawn by hashes, so that a scenario meets only its own events. A scene with too few events is an error. `before` counts the events of
    each of KINDS in the scenarios before, in the order of their places, or of hashes where `rows` have none.

    Rows are read twice: once for what each block of scenarios asks for, which is kept, and once for the draws.
    """
    wrong = ~F.col("pivot").isin(0, 1) | (F.col("has_rare_event") & (F.col("pivot") != 1))
    want = F.col("pivot") + F.col("verbal") + F.col("behavioral") + F.col("ambient")
    usual = want - F.col("has_rare_event").cast("int")
    placed = {"_block", "local"} <= set(rows.columns)
    at = (F.col("_block"), F.col("local")) if placed else (F.substring(hash_order(f"{salt}-register", "scenario_id"), 1, 2), hash_order(f"{salt}-register", "scenario_id"))
    own = rows.select(at[0].alias("_range"), at[1].alias("_at"), "scenario_id", "scene", "has_rare_event", want.alias("n"), *KINDS, usual.alias("_usual"), wrong.alias("wrong")).where("n > 0")
    sums = kept(own.groupBy("_range", "scene").agg(F.max("_usual").alias("n"), F.bool_or("has_rare_event").alias("has_rare_event"), F.bool_or("wrong").alias("wrong"), *[F.sum(k).alias(k) for k in KINDS]), "sums")
    short = short_pools(sums, pool, rare).limit(5).collect()
    if any(r["wrong"] for r in short):
        raise ValueError("a scenario has at most one pivot, and a rare event takes its place")
    if short:
        raise ValueError("too few events: " + "; ".join(f"scene {r['scene']!r} has {r['size']} of {r['n']}, {r['n_rare']} rare" for r in short))

    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    starts = sums.groupBy("_range").agg(*[F.sum(k).alias(k) for k in KINDS]).select("_range", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_{k}") for k in KINDS])
    inside = Window.partitionBy("_range").orderBy("_at", "scenario_id").rowsBetween(Window.unboundedPreceding, -1)
    sofar = own.withColumns({f"_own_{k}": F.coalesce(F.sum(k).over(inside), F.lit(0)) for k in KINDS}).join(starts, "_range", "left")
    reactions = F.flatten(F.array(*[F.array_repeat(F.lit(k), F.col(k).cast("int")) for k in KINDS]))
    slots = F.slice(reactions, F.col("has_rare_event").cast("int") + 1, F.col("_usual").cast("int"))
    asked = sofar.select("scenario_id", "scene", "has_rare_event", "n", "_usual", slots.alias("slots"), F.array(*[F.col(f"_{k}") + F.col(f"_own_{k}") for k in KINDS]).alias("before"))
    most = sums.agg(F.max("n")).first()[0] or 0
    found = with_drawn(asked, pool, F.col("_usual"), salt, most, "events")
    found = with_drawn(found, rare, F.col("has_rare_event").cast("int"), f"{salt}-rare", 1, "_rare")
    return found.select("scenario_id", "n", "events", "slots", F.get("_rare", F.lit(0)).alias("rare_event"), "before")


#: Most events times reactions whose counts are kept while pairs are balanced; they go to every task.
MOST_COUNTS = 1_000_000


def least_used(events: list[str], slots: list[str], order: dict[str, int], used: dict, pairs: dict, start: dict, share: float) -> list[str]:
    """The reaction of each event: the rarest reactions choose first, each the event that has least of it so far (of equals the first drawn).

    used and pairs count what this block has given out; `start` has (uses, uses with a reaction) before, of which `share` is this block's.
    """
    for e in events:
        used[e] = used.get(e, 0) + 1
    given: list[str | None] = [None] * len(events)
    for reaction in sorted(slots, key=order.__getitem__):
        free = [i for i, r in enumerate(given) if r is None]
        of = lambda i: (pairs.get((events[i], reaction), 0) + share * start.get((events[i], reaction), 0)) / (used[events[i]] + share * start.get((events[i], None), 0))  # noqa: B023, E731
        best = min(free, key=of)
        given[best] = reaction
        pairs[events[best], reaction] = pairs.get((events[best], reaction), 0) + 1
    return given


def paired(order: dict[str, int], start: dict, share: float):
    """Pairs a block's scenarios, in the order of their hashes, from its share of the counts so far: `slots` come in the order of `events`."""

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        used, pairs = {}, {}
        rows = rows.sort_values(["h", "scenario_id"])
        return rows.assign(slots=[least_used(list(r.events), list(r.slots), order, used, pairs, start, share) for r in rows.itertuples()]).drop(columns=["block", "h", "round"])

    return pair


def balanced(draws: DataFrame, targets: dict[str, float], rounds: int = 8, block: int = 4096, salt: str = "pair") -> DataFrame:
    """`draws` with slots in another order, so that every event meets the reactions in about equal shares.

    A choice depends on all choices before, through each event's uses with each reaction. Scenarios are dealt by hashes into rounds, and a
    round into blocks of about `block`, which run side by side: a block goes through its scenarios one after the other and
    starts from its part of the counts, as all blocks together make up for what the rounds before left uneven. Between
    rounds the counts, one per event and reaction of the catalogue, are summed up by Spark. One round of one block is the plain loop.
    """
    spark = draws.sparkSession
    folder = scratch(spark, "pairs")
    of_round = F.when(F.size("events") > 0, F.floor(uniform(f"{salt}-round", "scenario_id") * rounds)).otherwise(-1).cast("int")
    draws.withColumn("round", of_round).write.partitionBy("round").parquet(f"{folder}/drawn")
    drawn = spark.read.schema(T.StructType([*draws.schema.fields, T.StructField("round", T.IntegerType())])).parquet(f"{folder}/drawn")
    sizes = {r["round"]: r["n"] for r in drawn.where("round >= 0").groupBy("round").agg(F.count("*").alias("n")).collect()}
    order = {r: i for i, r in enumerate(sorted(KINDS, key=lambda r: targets.get(r, 0.0)))}
    start: dict = {}
    paths = []
    for number in sorted(sizes):
        blocks = -(-sizes[number] // block)
        place = F.pmod(F.xxhash64(F.lit(f"{salt}-block"), "scenario_id"), F.lit(blocks)).cast("int")
        own = drawn.where(F.col("round") == number).withColumn("block", place).withColumn("h", hash_order(salt, "scenario_id"))
        paths.append(f"{folder}/paired/round={number}")
        own.groupBy("block").applyInPandas(paired(order, dict(start), 1.0 / blocks), draws.schema).write.parquet(paths[-1])
        counts = with_reactions(spark.read.schema(draws.schema).parquet(paths[-1])).groupBy("event_id", "reaction").agg(F.count("*").alias("n"))
        for r in counts.limit(MOST_COUNTS + 1).collect():
            for key in ((r["event_id"], r["reaction"]), (r["event_id"], None)):
                start[key] = start.get(key, 0) + r["n"]
        if len(start) > 2 * MOST_COUNTS:
            raise ValueError(f"more than {MOST_COUNTS} events and reactions to balance")
    alone = drawn.where("round < 0").drop("round")
    return alone.unionByName(spark.read.schema(draws.schema).parquet(*paths)) if paths else alone


def with_reactions(draws: DataFrame) -> DataFrame:
    """(scenario_id, event_id, reaction): the ordinary events of the scenarios."""
    return draws.select("scenario_id", F.explode(F.arrays_zip(F.col("events").alias("e"), F.col("slots").alias("s"))).alias("p")).select("scenario_id", F.col("p.e").alias("event_id"), F.col("p.s").alias("reaction"))


def balanced_pairs(draws: DataFrame, targets: dict[str, float], rounds: int = 8, block: int = 4096, salt: str = "pair") -> DataFrame:
    """(scenario_id, event_id, reaction): balanced() as rows."""
    return with_reactions(balanced(draws, targets, rounds, block, salt))


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often it is used, also for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def events_of_scenarios(draws: DataFrame, salt: str = "event", registers: dict[str, list[str]] | None = None, targets: dict[str, float] | None = None) -> DataFrame:
    """(scenario_id, events: array of (place, event_id, reaction, is_rare, slot, register), by place): the events of every scenario, none of them twice.

    draws: scenario_draws(). Events meet the scenario's reactions as drawn or, with `targets` (shares of the reactions), as
    balanced() pairs them. Each reaction goes through its registers in cycles over all its events; one without any gives null. Events are
    placed in a hashed order over the thirds of the dialogue; a pivot never comes in the last one. All of this is worked out in the
    scenario's own row, so that nothing is shuffled.
    """
    rows = draws if targets is None else balanced(draws, targets, salt=f"{salt}-pair")
    hashed = lambda kind, *parts: F.sha1(F.concat_ws("|", F.lit(f"{salt}-{kind}"), F.col("scenario_id").cast("string"), *parts).cast("binary"))
    event = lambda e, reaction, is_rare: F.struct(hashed("place", e).alias("h"), e.alias("event_id"), reaction.alias("reaction"), F.lit(is_rare).alias("is_rare"))
    usual = F.zip_with("events", "slots", lambda e, r: event(e, r, False))
    own = F.sort_array(F.when(F.col("rare_event").isNotNull(), F.concat(usual, F.array(event(F.col("rare_event"), F.lit("pivot"), True)))).otherwise(usual))
    # thirds: all of them for three events, else the smallest hashes, in order
    third = lambda s: F.struct(hashed("third", F.lit(s)).alias("h"), F.lit(SLOTS.index(s)).alias("b"))
    bands = F.sort_array(F.slice(F.sort_array(F.array(*map(third, SLOTS))), F.lit(1), F.least(F.col("n"), F.lit(len(SLOTS))).cast("int"))["b"])

    names = F.array(*[F.array(*map(F.lit, (registers or {}).get(r, []))).cast("array<string>") for r in KINDS])

    def placed(x: Column) -> Column:
        """The events of a scenario by place, each with its reaction's number in KINDS and its rank among all events of that reaction."""
        first = (x["pivot_at"] >= 0) & (F.get(x["bands"], F.least(x["pivot_at"], F.size(x["bands"]) - 1)) == 2)  # a pivot in the last third changes places with the first

        def one(e: Column, i: Column) -> Column:
            place = F.when(~first, i).when(i == x["pivot_at"], 0).when(i == 0, x["pivot_at"]).otherwise(i)
            kind = F.array_position(F.array(*map(F.lit, KINDS)), e["reaction"]).cast("int") - 1
            earlier = F.size(F.filter(F.slice(x["reactions"], F.lit(1), i), lambda r: r == e["reaction"]))
            return F.struct(place.alias("place"), e["event_id"].alias("event_id"), e["reaction"].alias("reaction"), e["is_rare"].alias("is_rare"), F.get(x["bands"], F.least(place, F.size(x["bands"]) - 1)).alias("band"), kind.alias("kind"), (F.get(x["before"], kind) + earlier).alias("rank"))

        return F.sort_array(F.transform(x["own"], one))

    def told(e: Column) -> Column:
        slot = F.get(F.array(*map(F.lit, SLOTS)), F.when((e["reaction"] == "pivot") & (e["band"] == 2), 0).otherwise(e["band"]).cast("int"))
        own = F.get(names, e["kind"])
        register = F.get(own, quota.cycled(e["rank"], F.size(own), f"{salt}-cycle", e["reaction"])[1].cast("int"))
        return F.struct(e["place"].cast("long").alias("place"), e["event_id"].alias("event_id"), e["reaction"].alias("reaction"), e["is_rare"].alias("is_rare"), slot.alias("slot"), register.alias("register"))

    found = let(F.struct(own.alias("own"), bands.alias("bands"), F.col("before")), lambda x: let(F.struct(x["own"].alias("own"), x["bands"].alias("bands"), x["before"].alias("before"), x["own"]["reaction"].alias("reactions"), (F.array_position(x["own"]["reaction"], "pivot").cast("int") - 1).alias("pivot_at")), placed))
    return rows.select("scenario_id", F.transform(found, told).alias("events"))


def scenario_events(draws: DataFrame, salt: str = "event", registers: dict[str, list[str]] | None = None, targets: dict[str, float] | None = None) -> DataFrame:
    """(scenario_id, place, event_id, reaction, is_rare, slot, register): events_of_scenarios() as rows."""
    return events_of_scenarios(draws, salt, registers, targets).select("scenario_id", F.inline("events"))
