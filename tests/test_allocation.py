"""Drawn events, balanced pairs, registers, and how even they are."""

import math

import pytest
from pyspark.sql import functions as F

from parlance.operators import quota
from parlance.plans import allocation

ROWS = "scenario_id string, scene string, has_rare_event boolean, pivot int, verbal int, behavioral int, ambient int"
TARGETS = {"pivot": 0.1, "verbal": 0.2, "behavioral": 0.3, "ambient": 0.4}


def tables(spark, n, events=7):
    rows = [(f"s{i:03d}", "xy"[i % 2], i % 5 == 0, int(i % 5 == 0 or i % 3 == 0), (i // 2) % 2, (i // 4) % 2, i % 3 == 1) for i in range(n)]
    pool = spark.createDataFrame([(s, f"{s}{k}") for s in "xy" for k in range(events)], "scene string, event_id string")
    rare = spark.createDataFrame([("x", "rare_events/boom"), ("y", "rare_events/boom"), ("y", "rare_events/bang")], "scene string, event_id string")
    return spark.createDataFrame([(*r[:6], int(r[6])) for r in rows], ROWS), pool, rare


def plain_loop(draws):
    """One scenario after the other, with running counts; of equals the first drawn."""
    used, pairs, out = {}, {}, set()
    for sid, events, slots in draws:
        for e in events:
            used[e] = used.get(e, 0) + 1
        free = list(events)
        for reaction in sorted(slots, key=lambda r: TARGETS[r]):
            best = min(free, key=lambda e: pairs.get((e, reaction), 0) / used[e] - TARGETS[reaction])
            free.remove(best)
            pairs[best, reaction] = pairs.get((best, reaction), 0) + 1
            out.add((sid, best, reaction))
    return out


def test_one_round_of_one_block_is_the_plain_loop(spark):
    draws = allocation.scenario_draws(*tables(spark, 120))
    order = draws.where("size(events) > 0").withColumn("h", quota.hash_order("pair", "scenario_id")).orderBy("h", "scenario_id")
    want = plain_loop([(r["scenario_id"], r["events"], r["slots"]) for r in order.collect()])
    assert {tuple(r) for r in allocation.balanced_pairs(draws, TARGETS, rounds=1).collect()} == want


@pytest.mark.parametrize(("rounds", "block"), [(4, 4096), (4, 20)])
def test_balanced_pairs_are_more_even(spark, rounds, block):
    draws = allocation.scenario_draws(*tables(spark, 600))
    plain = draws.select("scenario_id", F.explode(F.arrays_zip("events", F.col("slots").alias("slots"))).alias("p")).select("scenario_id", F.col("p.events").alias("event_id"), F.col("p.slots").alias("reaction"))
    even = allocation.balanced_pairs(draws, TARGETS, rounds, block)
    assert {tuple(r) for r in even.select("scenario_id", "event_id").collect()} == {tuple(r) for r in plain.select("scenario_id", "event_id").collect()}
    count = lambda df: sorted(tuple(r) for r in df.groupBy("scenario_id", "reaction").count().collect())
    assert count(even) == count(plain)
    before, after = (quota.event_balance(df, "event_id", "reaction").first() for df in (plain, even))
    assert after["mean_gap"] < before["mean_gap"] and after["max_gap"] < before["max_gap"]


def test_draws_differ_and_follow_the_pool(spark):
    rows, pool, rare = tables(spark, 300, events=3)
    for r in allocation.scenario_draws(rows, pool, rare).collect():
        assert len(set(r["events"])) == len(r["events"]) == len(r["slots"]) and len(r["events"]) + (r["rare_event"] is not None) == r["n"]
    places = spark.range(4000).select(allocation.drawn_places(F.lit(2), F.lit(3), "s", "id").alias("p")).groupBy("p").count().collect()
    assert len(places) == 6 and all(abs(r["count"] - 4000 / 6) < 5 * math.sqrt(4000 / 6) for r in places)


def test_too_few_events_are_an_error(spark):
    rows, pool, rare = tables(spark, 30)
    with pytest.raises(ValueError, match="'y' has 1 of"):
        allocation.scenario_draws(rows, pool.where("scene = 'x' OR event_id = 'y1'"), rare)
    with pytest.raises(ValueError, match="0 rare"):
        allocation.scenario_draws(rows, pool, rare.where("scene = 'x'"))
    with pytest.raises(ValueError, match="at most one pivot"):
        allocation.scenario_draws(rows.withColumn("pivot", F.lit(2)), pool, rare)


def test_registers_go_in_cycles(spark):
    rows, pool, rare = tables(spark, 90)
    found = allocation.scenario_events(allocation.scenario_draws(rows, pool, rare), registers={"pivot": ["p", "q"], "verbal": ["u", "v", "w"]}, targets=TARGETS)
    counts = {(r["reaction"], r["register"]): r["count"] for r in found.groupBy("reaction", "register").count().collect()}
    total = lambda x: sum(n for (reaction, _), n in counts.items() if reaction == x)
    assert {k[0] for k in counts if k[1] is None} == {"behavioral", "ambient"}
    for reaction, names in (("pivot", "pq"), ("verbal", "uvw")):
        own = [counts[reaction, name] for name in names]
        assert sum(own) == total(reaction) and max(own) - min(own) <= 1


def test_balance_leaves_rare_events_out(spark):
    # a: 3 pivots, 1 verbal; general/b: 1 verbal, 1 ambient; c: 1 pivot. Overall 4/7, 2/7, 0, 1/7.
    rows = [("a", "pivot")] * 3 + [("a", "verbal"), ("general/b", "verbal"), ("general/b", "ambient"), ("c", "pivot")] + [("rare_events/r", "pivot")] * 5
    found = quota.event_balance(spark.createDataFrame(rows, "e string, r string"), "e", "r").first().asDict()
    gaps = [abs(x - y) for own in ((3 / 4, 1 / 4, 0, 0), (0, 1 / 2, 0, 1 / 2), (1, 0, 0, 0)) for x, y in zip(own, (4 / 7, 2 / 7, 0, 1 / 7))]
    want = {"n_placements": 12, "n_event_ids": 4, "least": 1, "median": 2, "most": 4, "n_general": 1, "mean_general": 2.0, "share_general": 2 / 7, "n_scene": 2, "mean_scene": 2.5, "share_pivot": 4 / 7, "share_behavioral": 0.0, "mean_gap": 100 * sum(gaps) / 12, "max_gap": 100 * max(gaps)}
    assert all(found[k] == pytest.approx(v) for k, v in want.items())
    none = quota.event_balance(spark.createDataFrame([("rare_events/r", "pivot")], "e string, r string"), "e", "r").first()
    assert (none["n_placements"], none["least"], none["median"], none["mean_gap"], none["share_pivot"]) == (1, 0, 0, 0.0, None)


def test_no_task_holds_a_large_group(spark):
    n = 1_000_000
    rows = spark.range(n).select("id", F.lit("one").alias("g"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        found = quota.ranked(rows, ["g"], [quota.hash_order("x", "id"), F.col("id")])
        parts = found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.sum("rank").alias("s"), F.max("n").alias("n")).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sum(r["c"] for r in parts) == n and sum(r["s"] for r in parts) == n * (n - 1) // 2 and {r["n"] for r in parts} == {n}
    assert min(r["low"] for r in parts) == 0 and max(r["high"] for r in parts) == n - 1 and max(r["c"] for r in parts) < n / 4


def test_ranks_of_nulls_and_numbers(spark):
    df = spark.createDataFrame([(None, 3), (None, None), ("a", 1 << 30), ("a", 5), ("a", -7)], "g string, v long")
    found = {(r["g"], r["v"]): (r["rank"], r["n"]) for r in quota.ranked(df, ["g"], ["v"]).collect()}
    assert found == {(None, None): (0, 2), (None, 3): (1, 2), ("a", -7): (0, 3), ("a", 5): (1, 3), ("a", 1 << 30): (2, 3)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def many_todos(spark, n, **more):
    templates = spark.range(n).withColumnRenamed("id", "t")
    return allocation.todos(templates, "t", "t", spark.createDataFrame([("x",), ("y",)], "scene string"), spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "f")], "role_a string, role_b string"), **more)


def test_scenarios_are_not_broadcast(spark):
    rows = many_todos(spark, 30)
    assert "BroadcastHashJoin [local" not in plan(rows) and "TakeOrdered" not in plan(rows) and "Limit" not in plan(rows)
    assert rows.count() == 300 and rows.where("has_rare_event").count() == 15


def test_units_made_by_many_tasks_are_the_same(spark, monkeypatch):
    of = lambda: sorted(tuple(r) for r in many_todos(spark, 60).collect())
    want = of()
    monkeypatch.setattr(allocation, "UNITS", 100)
    monkeypatch.setattr(allocation, "RUN", 7)
    assert of() == want and len(want) == 600


@pytest.mark.parametrize("registers", [None, {"pivot": ["p", "q"], "verbal": ["u"]}])
def test_events_of_scenarios_are_not_broadcast(spark, registers):
    draws = allocation.scenario_draws(*tables(spark, 60))
    assert "BroadcastHashJoin [scenario_id" not in plan(allocation.scenario_events(draws, registers=registers))


def test_balanced_pairs_are_not_broadcast(spark):
    draws = allocation.scenario_draws(*tables(spark, 60))
    assert "BroadcastHashJoin [scenario_id" not in plan(allocation.scenario_events(draws, targets=TARGETS))


def test_rows_are_not_the_small_side_of_their_ranks(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("g"))
    found = quota.ranked(rows, ["g"], ["id"])
    assert "BuildLeft" not in plan(found)
    assert found.where("rank <> id DIV 3 OR n <> 1000 OR rank IS NULL").count() == 0 and found.count() == 3000


def test_scenarios_are_not_the_small_side_of_their_pools(spark):
    some = spark.createDataFrame([("a", "x", 2), ("b", "y", 1), ("c", "z", 0)], "scenario_id string, scene string, k int")
    pool = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("scene"), F.col("id").cast("string").alias("event_id"))
    found = allocation.drawn_events(some, pool, F.col("k"), "draw")
    assert "BuildLeft" not in plan(found)
    rows = found.join(pool.withColumnRenamed("scene", "of"), "event_id").join(some, "scenario_id").collect()
    assert sorted((r["scenario_id"], r["i"]) for r in rows) == [("a", 0), ("a", 1), ("b", 0)] and all(r["of"] == r["scene"] for r in rows)


def test_events_follow_from_their_scenario_without_a_shuffle(spark):
    pool = spark.createDataFrame([(s, f"{s}{k}") for s in "xy" for k in range(7)], "scene string, event_id string")
    rare = spark.createDataFrame([(s, "rare_events/boom") for s in "xy"], "scene string, event_id string")
    found = allocation.scenario_events(allocation.scenario_draws(many_todos(spark, 60), pool, rare), registers={"pivot": ["p", "q"], "verbal": ["u", "v", "w"]})
    text = plan(found)
    keys = [line.split("hashpartitioning(")[1] for line in text.splitlines() if "hashpartitioning(" in line]
    assert keys and all(k.startswith(("_block", "_range", "scene", "event")) for k in keys), keys
    assert sum(k.startswith("_block") for k in keys) == 2  # templates and blocks, each once
    rows = found.collect()
    assert len({(r["scenario_id"], r["event_id"]) for r in rows}) == len({(r["scenario_id"], r["place"]) for r in rows}) == len(rows) > 600
    for reaction, names in (("pivot", "pq"), ("verbal", "uvw")):
        own = [sum(r["reaction"] == reaction and r["register"] == name for r in rows) for name in names]
        assert sum(own) == sum(r["reaction"] == reaction for r in rows) and max(own) - min(own) <= 1


def test_blocks_of_any_size_are_the_same(spark, monkeypatch):
    of = lambda: sorted((r["scenario_id"], r["local"], r["composition"], r["scene"], r["role_a"], r["gender_a"], r["has_rare_event"]) for r in many_todos(spark, 12, per_template=9).collect())
    want = of()
    monkeypatch.setattr(allocation, "BLOCK", 4)  # a template has several blocks, and a range of hashes too
    assert of() == want and [r[1] for r in sorted(want, key=lambda r: r[1])] == list(range(108))


def test_a_sequence_is_in_the_order_of_its_hashes(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(allocation, "BLOCK", 8)
    values = spark.createDataFrame([("a", 1, 70), ("b", 2, 0), ("c", None, 55)], "x string, y int, quota long")
    found = {r["local"]: (r["x"], r["y"]) for r in allocation.dealt(values, "salt", 125).collect()}
    units = [(("a", 1), f"salt|a|1|{u}") for u in range(70)] + [(("c", None), f"salt|c|{u}") for u in range(55)]
    assert found == dict(enumerate(v for v, _ in sorted(units, key=lambda p: hashlib.sha1(p[1].encode()).hexdigest())))


def test_rare_scenarios_have_the_smallest_hashes(spark):
    comps = spark.range(2000).select(F.col("id").alias("local"), (F.col("id") % 3 == 0).cast("int").alias("pivot"))
    ranked = [r["local"] for r in comps.where("pivot = 1").orderBy(quota.hash_order("rare", "local"), "local").collect()]
    for rate in (0.0, 0.0005, 0.1, 0.9):
        found = {r["local"] for r in allocation.with_rare_flags(comps, 2000, rate).where("has_rare_event").collect()}
        assert found == set(ranked[: round(2000 * rate)])
