"""Quotas, splits and shards, drawn from hashes instead of random streams.

Orders come from hashes of ids with a salt, so that every draw is the same wherever it is made, needs no
state, and can be repeated in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators.metrics import upper_medians

SPLITS = ("train", "dev", "test")


def hash_order(salt: str, *columns: str) -> Column:
    """Hexadecimal SHA-1 of salt|column|...: an order that looks random."""
    return F.sha1(F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def uniform(salt: str, *columns: str) -> Column:
    """A number in [0, 1) from the first eight digits of the hash."""
    return F.conv(F.substring(hash_order(salt, *columns), 1, 8), 16, 10).cast("double") / 4294967296.0


def compositions(spark, most: int = 3) -> DataFrame:
    """All (pivot, verbal, behavioral, ambient) of at most `most` events and at most one pivot, in order."""
    n = F.sequence(F.lit(0), F.lit(most))
    rows = spark.range(1).select(F.explode(n).alias("total")).select("total", F.explode(F.array(F.lit(0), F.lit(1))).alias("pivot"))
    rows = rows.select("total", "pivot", F.explode(n).alias("verbal")).select("total", "pivot", "verbal", F.explode(n).alias("behavioral"))
    rows = rows.withColumn("ambient", F.expr("total - pivot - verbal - behavioral")).where("ambient >= 0")
    key = F.format_string("P%dV%dB%dA%d", "pivot", "verbal", "behavioral", "ambient")
    order = Window.orderBy("total", "pivot", "verbal", "behavioral")  # 30 rows by default
    return rows.select((F.row_number().over(order) - 1).alias("position"), key.alias("composition"), "pivot", "verbal", "behavioral", "ambient")


def even_quota(total: Column, k: int | Column, i: Column) -> Column:
    """The i-th (from 0) of k even parts; the remainder goes to the first ones."""
    return (F.floor(total / k) + F.when(i < total % k, 1).otherwise(0)).cast("long")


def largest_remainder(df: DataFrame, total: str, weight: str, position: str, by: tuple[str, ...] = ()) -> DataFrame:
    """`df` with `quota`: `total` shared out by `weight` within a group.

    Floors first, then one more for the largest fractions, ties by position; weights that are all zero count
    as equal. Groups are lists of parts, so their windows are small.
    """
    group = Window.partitionBy(*by)
    sum_w, parts = F.sum(weight).over(group), F.count("*").over(group)
    df = df.withColumn("_exact", F.when(sum_w > 0, F.col(total) * F.col(weight) / sum_w).otherwise(F.col(total) / parts).cast("double"))
    df = df.withColumn("_floor", F.floor("_exact").cast("long"))
    rank = F.row_number().over(group.orderBy(F.desc(F.col("_exact") - F.col("_floor")), position))
    left = F.col(total) - F.sum("_floor").over(group)
    return df.withColumn("quota", (F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("_exact", "_floor")


def leading_range(df: DataFrame, first: Column) -> Column:
    """A value that never falls while `first` rises and cuts it into ranges: two characters of a text, 2^24 of a whole number; else one range."""
    kind = df.select(first).schema[0].dataType
    if isinstance(kind, T.StringType):
        return F.substring(first, 1, 2)
    if isinstance(kind, T.IntegralType):
        return F.floor(first / F.lit(float(1 << 24)))
    return F.lit(0)


def ranked(df: DataFrame, by: list[str], order: list[Column | str], ranges: Column | None = None) -> DataFrame:
    """`df` with rank (from 0) and group size n within `by`.

    Ranks are counted within ranges of the order's first entry, and the sizes of a group's ranges before are added, so that no
    task holds a group of which there are only a few. Hashes, as leading entry, cut a group into 256 even ranges. Other `ranges` of
    that entry, such as value_ranges(), may be given. Every row meets its range; a left join keeps Spark from ever taking the rows for
    the small side, as their estimated size may be the lesser one, and sending them through the driver.
    """
    first = order[0] if isinstance(order[0], Column) else F.col(order[0])
    rows = df.withColumn("_range", leading_range(df, first) if ranges is None else ranges)
    sizes = rows.groupBy(*by, "_range").agg(F.count("*").alias("_size"))
    whole = Window.partitionBy(*by)
    before = F.sum("_size").over(whole.orderBy(F.col("_range").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    keys = [*by, "_range"]
    places = sizes.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)], F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(whole).alias("n"))
    own = rows.drop("rank", "n").withColumn("_own", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)])
    return own.join(places, same, "left").withColumn("rank", (F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_before", *[f"_key{i}" for i in range(len(keys))])


def split_counts(n: Column, ratios: dict[str, float], each_one: bool = False) -> Column:
    """How many of n go to train, dev and test, as an array: largest remainder, ties in that order.

    each_one: every split with a ratio gets at least one where n allows, taken from the largest (the first
    of equals) while that keeps one; fewer than there are such splits: one each for the first n.
    """
    exact = {s: (n * F.lit(float(ratios.get(s, 0.0)))) for s in SPLITS}
    floor = {s: F.floor(exact[s]).cast("long") for s in SPLITS}
    left = n - sum(floor.values(), F.lit(0))
    fraction = {s: exact[s] - floor[s] for s in SPLITS}

    def place(s: str) -> Column:
        """How many splits are before s by falling fraction, then by order."""
        i = SPLITS.index(s)
        others = [(fraction[o] > fraction[s]) if SPLITS.index(o) > i else (fraction[o] >= fraction[s]) for o in SPLITS if o != s]
        return sum((c.cast("int") for c in others), F.lit(0))

    counts = F.array(*[(floor[s] + F.when(place(s) < left, 1).otherwise(0)).cast("long") for s in SPLITS])
    if not each_one:
        return counts
    wanted = [s for s in SPLITS if ratios.get(s, 0.0) > 0]

    def fill(now: Column, i: Column) -> Column:
        """`now` with one moved to place i from the first of the largest, where i has none and another has two."""
        moved = F.transform(now, lambda c, k: c + (k == i).cast("long") - (k == F.array_position(now, F.array_max(now)) - 1).cast("long"))
        return F.when((F.get(now, i) == 0) & (F.array_max(now) > 1), moved).otherwise(now)

    filled = F.aggregate(F.array(*[F.lit(SPLITS.index(s)) for s in wanted]), counts, fill)
    few = F.array(*[F.when(n > wanted.index(s), 1).otherwise(0).cast("long") if s in wanted else F.lit(0).cast("long") for s in SPLITS])
    return F.when(n >= len(wanted), filled).otherwise(few)


def assign_split(df: DataFrame, by: list[str], order: list[Column | str], ratios: dict[str, float], each_one: bool = False) -> DataFrame:
    """`df` with `split`: each group, in the given order, cut into train, dev and test.

    Ranks come from ranges of the order's first entry, see ranked().
    """
    rows = ranked(df, by, order).withColumn("_counts", split_counts(F.col("n"), ratios, each_one))
    train, dev = F.get("_counts", F.lit(0)), F.get("_counts", F.lit(1))
    split = F.when(F.col("rank") < train, "train").when(F.col("rank") < train + dev, "dev").otherwise("test")
    return rows.withColumn("split", split).drop("rank", "n", "_counts")


def proportional_shares(size: Column, left: Column) -> Column:
    """How many of a group of `size` go to each split, as an array, in proportion to what is `left` for each.

    Floors first, then one more for the largest fractions (ties in the splits' order) of those that have any left.
    """
    total = F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x)
    exact = F.transform(left, lambda x: F.coalesce(F.try_divide((size * x).cast("double"), total.cast("double")), F.lit(0.0)))
    base = F.zip_with(exact, left, lambda e, x: F.least(F.floor(e).cast("long"), x))
    rest = size - F.aggregate(base, F.lit(0).cast("long"), lambda a, x: a + x)
    open_ = F.transform(base, lambda b, i: F.get(left, i) > b)
    fraction = F.transform(exact, lambda e: e - F.floor(e))

    def before(i: Column) -> Column:
        """How many splits with some left come before split i."""
        first = lambda f, j: F.get(open_, j) & ((f > F.get(fraction, i)) | ((f == F.get(fraction, i)) & (j < i)))
        return F.size(F.filter(F.transform(fraction, first), lambda x: x))

    return F.transform(base, lambda b, i: b + (F.get(open_, i) & (before(i) < rest)).cast("long"))


#: Most groups that assign_sizes() folds in one row.
MOST_GROUPS = 100_000


def assign_sizes(df: DataFrame, by: list[str], order: list[Column | str], sizes: dict[str, int]) -> DataFrame:
    """`df` with `split`: in all as many rows per split as `sizes` asks for, spread over the groups of `by`.

    Groups are taken in the order of their names, each shared out in proportion to what the splits still need, which is
    carried from group to group. The groups' names and sizes (a catalogue's categories and themes) are folded in one row;
    the rows themselves are ranked within their group. More than MOST_GROUPS raise.
    """
    name = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in by])
    groups = df.groupBy(name.alias("_g")).agg(F.count("*").alias("n"))
    few = F.when(F.count("*") > MOST_GROUPS, F.raise_error(F.lit(f"more than {MOST_GROUPS} groups"))).otherwise(F.array_sort(F.collect_list(F.struct("_g", "n"))))
    listed = groups.agg(few.alias("groups"))
    needed = F.array(*[F.lit(int(sizes.get(s, 0))).cast("long") for s in SPLITS])
    none = F.expr("cast(array() as array<struct<_g:string,shares:array<bigint>>>)")

    def step(acc: Column, g: Column) -> Column:
        shares = proportional_shares(g["n"], acc["left"])
        return F.struct(F.concat(acc["done"], F.array(F.struct(g["_g"].alias("_g"), shares.alias("shares")))).alias("done"), F.zip_with(acc["left"], shares, lambda x, y: x - y).alias("left"))

    shares = listed.select(F.explode(F.aggregate("groups", F.struct(none.alias("done"), needed.alias("left")), step, lambda acc: acc["done"])).alias("s")).select("s.*")
    rows = ranked(df.withColumn("_g", name), ["_g"], order).join(shares, "_g")
    train, dev, test = (F.get("shares", F.lit(i)) for i in range(3))
    split = F.when(F.col("rank") < train, "train").when(F.col("rank") < train + dev, "dev").when(F.col("rank") < train + dev + test, "test")
    return rows.withColumn("split", split).drop("_g", "rank", "n", "shares")


def partition_files(files: DataFrame, ratios: dict[str, float], pool: str = "pool", name: str = "name", salted_by: str | None = None) -> DataFrame:
    """`files` with `split`, each pool ordered by the CRC-32 of salt|name, then the name; every split gets a file where there are enough."""
    salt = F.col(salted_by or pool).cast("string")
    key = F.crc32(F.concat_ws("|", salt, F.col(name).cast("string")).cast("binary"))
    return assign_split(files, [pool], [key, F.col(name)], ratios, each_one=True)


def pool_gaps(files: DataFrame, needed: tuple[str, ...] = SPLITS, pool: str = "pool") -> DataFrame:
    """(pool, train, dev, test) of pools where a needed split has no file."""
    counts = files.groupBy(pool).agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    return counts.where(" OR ".join(f"{s} = 0" for s in needed))


def shared_between_splits(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(key, splits): keys that occur in more than one split."""
    found = df.where(F.col(split).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return found.where(F.size("splits") > 1)


def split_report(df: DataFrame, template: str, theme: str) -> DataFrame:
    """Rows, distinct templates and themes per split."""
    return df.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct(template).alias("templates"), F.countDistinct(theme).alias("themes"))


def dataset_split_report(scenarios: DataFrame, events: DataFrame, key: str = "scenario_id", template: str = "template_id", theme: str = "theme", reactions: tuple[str, ...] = ("pivot", "verbal", "behavioral", "ambient")) -> DataFrame:
    """Per split: scenarios, templates, themes, events, scenes and compositions with the least and most scenarios of one, rare scenarios, and each reaction's number and share.

    scenarios: (key, split, template, theme, scene, composition, has_rare_event); events: (key, reaction). Shares of no events are null.
    """
    own = scenarios.groupBy("split").agg(F.count("*").alias("n_scenarios"), F.count_distinct(template).alias("n_templates"), F.count_distinct(theme).alias("n_themes"), F.count_if("has_rare_event").alias("n_rare"))
    for name in ("scene", "composition"):
        sizes = scenarios.groupBy("split", name).agg(F.count("*").alias("_n")).groupBy("split")
        own = own.join(sizes.agg(F.count("*").alias(f"n_{name}s"), F.min("_n").alias(f"least_{name}"), F.max("_n").alias(f"most_{name}")), "split")
    heard = events.select(key, "reaction").join(scenarios.select(key, "split").hint("merge"), key).groupBy("split").agg(F.count("*").alias("n_events"), *[F.count_if(F.col("reaction") == r).alias(f"n_{r}") for r in reactions])
    rows = own.join(heard, "split", "left").fillna(0, ["n_events", *[f"n_{r}" for r in reactions]])
    return rows.withColumns({f"share_{r}": F.try_divide(f"n_{r}", "n_events") for r in reactions})


def audited_sources(manifests: DataFrame, split: str = "split", events: str = "events_placed", background: str = "background_source") -> DataFrame:
    """(source, splits, n): source files of placed events and backgrounds that scenes of more than one split use; scenes without a split count under a null source.

    n: the scenes that use it. Empty sources don't count.
    """
    of = F.array_distinct(F.concat(F.coalesce(F.transform(events, lambda e: e["source_file"]), F.array().cast("array<string>")), F.array(F.col(background))))
    known = F.coalesce(F.col(split), F.lit("")) != ""
    used = manifests.where(known).select(split, F.explode(of).alias("source")).where("source <> ''").groupBy("source", split).agg(F.count("*").alias("n"))
    shared = used.groupBy("source").agg(F.array_sort(F.collect_set(split)).alias("splits"), F.sum("n").alias("n")).where("size(splits) > 1")
    lacking = manifests.where(~known).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(None).cast("string").alias("source"), F.array().cast("array<string>").alias("splits"), "n")
    return shared.unionByName(lacking)


def value_ranges(df: DataFrame, order: str, parts: int) -> Column:
    """The number of the range of `order` (a number or a time) that a row is in; about equally many rows share one, and equal values always do.

    Which range a row is in follows from its value alone; nulls are in none.
    """
    cuts = df.agg(F.percentile_approx(F.col(order), [i / parts for i in range(1, parts)], F.lit(10 * parts))).first()[0] if parts > 1 else []
    cuts = F.array(*[F.lit(x) for x in sorted(set(cuts or []))]).cast(f"array<{df.schema[order].dataType.simpleString()}>")
    return F.when(F.col(order).isNotNull(), F.size(F.filter(cuts, lambda x: x < F.col(order))))


def round_robin(df: DataFrame, order: str | list[str], shards: int, parts: int = 64) -> DataFrame:
    """`df` with `shard`, the rank in `order` (whose first is a number or a time) modulo `shards`.

    The rank is made without sorting all rows in one task: quantiles cut the order into `parts` ranges, ranks are
    counted within them, and the ranges' sizes are added up.
    """
    names = [order] if isinstance(order, str) else order
    rows = df.withColumn("_part", value_ranges(df, names[0], parts))
    own = Window.partitionBy("_part").orderBy(*names)
    before = Window.orderBy(F.col("_part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = rows.groupBy("_part").agg(F.count("*").alias("_size")).select(F.col("_part").alias("_key"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    ranked_rows = rows.withColumn("_own", F.row_number().over(own) - 1).join(F.broadcast(offsets), F.col("_part").eqNullSafe(F.col("_key")))
    return ranked_rows.withColumn("shard", ((F.col("_before") + F.col("_own")) % shards).cast("long")).drop("_part", "_key", "_before", "_own")


def shard_sizes(sharded: DataFrame, shards: int) -> DataFrame:
    """(shard, n) for every shard from 0, empty ones too; rows of no such shard are counted under null."""
    known = F.when(F.col("shard").between(0, shards - 1), F.col("shard").cast("long"))
    counts = sharded.groupBy(known.alias("shard")).agg(F.count("*").alias("n"))
    every = sharded.sparkSession.range(shards).select(F.col("id").alias("shard"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(every).groupBy("shard").agg(F.sum("n").alias("n"))


def cycled(rank: Column, registers: Column, salt: str, *group: Column) -> tuple[Column, Column]:
    """The cycle and register of the draw with this rank in its group: all registers once per cycle, in the order of the hashes of salt|group|cycle|register."""
    registers = F.nullif(registers, F.lit(0)).cast("int")
    cycle = F.floor(rank / registers).cast("long")
    key = lambda r: F.sha1(F.concat_ws("|", F.lit(salt), *[c.cast("string") for c in group], cycle.cast("string"), r.cast("string")).cast("binary"))
    drawn = F.sort_array(F.transform(F.sequence(F.lit(0), registers - 1), lambda r: F.struct(key(r).alias("k"), r.cast("long").alias("r"))))
    return cycle, F.get(drawn, (rank % registers).cast("int"))["r"]


def register_cycle(df: DataFrame, by: list[str], order: list[Column | str], registers: int | Column, salt: str = "cycle") -> DataFrame:
    """`df` with cycle and `register`: draws without repetition until all have been used, in an order drawn anew per cycle.

    A cycle's order is that of the hashes of salt|group|cycle|register. `registers` may differ between groups; where there
    are none, both are null.
    """
    cycle, register = cycled(F.col("rank"), F.lit(registers) if isinstance(registers, int) else registers, salt, *map(F.col, by))
    return ranked(df, by, order).withColumn("cycle", cycle).withColumn("register", register).drop("rank", "n")


#: How the ids of rare events and of events of no scene start.
RARE_PREFIX, GENERAL_PREFIX = "rare_events/", "general/"


def event_balance(placements: DataFrame, event: str, reaction: str, reactions: tuple[str, ...] = ("pivot", "verbal", "behavioral", "ambient")) -> DataFrame:
    """One row: how evenly events are used, and how far each event's reactions are from the overall shares (points).

    n_placements and n_event_ids count rare events too; all other figures leave them out: least, upper median and most uses of
    an event; number, mean use and share of the general ones, number and mean use of the others; mean and largest deviation; and the
    reactions' overall shares. Figures of no events are 0, shares of no events null.
    """
    counts = placements.groupBy(event, reaction).agg(F.count("*").alias("c"))
    wide = counts.groupBy(F.col(event).alias("event")).agg(F.sum("c").alias("used"), *[F.sum(F.when(F.col(reaction) == r, F.col("c")).otherwise(0)).alias(f"r{i}") for i, r in enumerate(reactions)])
    every = wide.agg(F.coalesce(F.sum("used"), F.lit(0)).alias("n_placements"), F.count("*").alias("n_event_ids"))
    usual = wide.where(~F.col("event").startswith(RARE_PREFIX))
    general = F.col("event").startswith(GENERAL_PREFIX)
    uses = usual.agg(
        F.coalesce(F.min("used"), F.lit(0)).alias("least"), F.coalesce(F.max("used"), F.lit(0)).alias("most"), F.count_if(general).alias("n_general"), F.count_if(~general).alias("n_scene"),
        F.coalesce(F.avg(F.when(general, F.col("used"))), F.lit(0.0)).alias("mean_general"), F.coalesce(F.avg(F.when(~general, F.col("used"))), F.lit(0.0)).alias("mean_scene"),
        F.coalesce(F.try_divide(F.sum(F.when(general, F.col("used"))), F.sum("used")), F.lit(0.0)).alias("share_general"),
        *[F.try_divide(F.sum(f"r{i}"), F.sum("used")).alias(f"share_{r}") for i, r in enumerate(reactions)],
    )
    median = upper_medians(usual, "used").agg(F.coalesce(F.max("median"), F.lit(0)).alias("median"))
    gap = F.explode(F.array(*[F.abs(F.col(f"r{i}") / F.col("used") - F.col(f"share_{r}")) for i, r in enumerate(reactions)]))
    gaps = usual.join(F.broadcast(uses.select(*[f"share_{r}" for r in reactions])), F.lit(True)).select(gap.alias("gap"))  # one row of shares
    gaps = gaps.agg(F.coalesce(100 * F.avg("gap"), F.lit(0.0)).alias("mean_gap"), F.coalesce(100 * F.max("gap"), F.lit(0.0)).alias("max_gap"))
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), [every, uses, median, gaps])  # four single rows


#: Fixed value: share of a scene's ordinary events that are placed as supporting ones.
SUPPORTING_RATE = 0.35


def layer(event_id: Column, is_rare: Column, u: Column, rate: float = SUPPORTING_RATE) -> Column:
    """Whether an event is rare, supporting or core; null for an event without an id. u: a uniform number of the event."""
    rare = F.coalesce(is_rare, F.lit(False)) | event_id.startswith("rare_events/")
    return F.when(F.coalesce(event_id, F.lit("")) != "", F.when(rare, "rare").when(u < rate, "supporting").otherwise("core"))


def layer_sets(dialogues: DataFrame, key: str, salt: str = "layer") -> DataFrame:
    """(key, core, supporting, rare): ids of a dialogue's events by layer, each id once and in order.

    dialogues: (key, events: array of (event_id, is_rare), core_elements and supporting_elements: arrays of (event_id, nature)). Events come by
    layer(); of the elements only sounds (nature acoustic_event) count, whose id no event has. Ids drawn twice share a layer.
    """
    none, ids = F.array().cast("array<string>"), lambda c: F.transform(c, lambda e: e["event_id"])
    drawn = lambda i: F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(salt), F.col(key).cast("string"), i).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    layered = F.transform("events", lambda e: F.struct(e["event_id"].alias("event_id"), layer(e["event_id"], e["is_rare"], drawn(e["event_id"])).alias("layer")))
    rows = dialogues.withColumn("_l", layered).withColumn("_rare", F.coalesce(ids(F.filter("_l", lambda e: e["layer"] == "rare")), none))
    of = lambda name: F.array_except(F.coalesce(ids(F.filter("_l", lambda e: e["layer"] == name)), none), F.col("_rare"))
    rows = rows.withColumn("_core", of("core")).withColumn("_supporting", of("supporting")).withColumn("_known", F.concat("_core", "_supporting", "_rare"))
    more = lambda c: F.array_except(F.coalesce(ids(F.filter(c, lambda e: (e["nature"] == "acoustic_event") & (e["event_id"] != ""))), none), F.col("_known"))
    rows = rows.withColumn("_more", more("core_elements"))
    is_rare = lambda i: i.startswith(RARE_PREFIX)
    sets = {"core": F.concat("_core", F.filter("_more", lambda i: ~is_rare(i))), "supporting": F.concat("_supporting", more("supporting_elements")), "rare": F.concat("_rare", F.filter("_more", is_rare))}
    return rows.select(key, *[F.array_sort(F.array_distinct(c)).alias(n) for n, c in sets.items()])


def parse_sizes(spec: str | None, n: int) -> dict[str, int] | None:
    """Rows per split from `train/dev/test`, as numbers or percentages of n, which must add up to n; None for no split."""
    if not spec or spec.lower() in ("none", "off"):
        return None
    parts = [p.strip() for p in spec.split("/")]
    if len(parts) != len(SPLITS):
        raise ValueError(f"expected train/dev/test or none, got {spec!r}")
    sizes = {s: round(n * float(p[:-1]) / 100) if p.endswith("%") else int(p) for s, p in zip(SPLITS, parts)}
    if sum(sizes.values()) != n or min(sizes.values()) < 0:
        raise ValueError(f"{sizes} do not share out {n} rows")
    return sizes
