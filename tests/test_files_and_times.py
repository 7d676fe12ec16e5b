"""Files by split, alignment files, overlaps, spaced turns, grounding items and recovery figures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import signal
from parlance.operators import alignment, catalog, filtering, items, placement
from parlance.queries import QUERIES
from parlance.sources import tables


def test_takes(spark):
    files = spark.createDataFrame([("p", "train", "a"), ("p", "train", "b"), ("p", "dev", "c"), ("q", None, "d"), (None, "dev", "e"), ("p", "dev", None)], "pool string, split string, name string")
    wants = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate([("p", "train"), ("p", "dev"), ("p", "test"), ("q", "dev"), ("q", None), ("p", ""), ("z", "dev"), (None, "dev")] * 20)], "k long, pool string, split string")
    found = catalog.takes(wants, files, "k").collect()
    assert len(found) == 160
    by = {}
    for r in found:
        by.setdefault((r["pool"], r["split"]), set()).add(r["name"])
    assert by == {("p", "train"): {"a", "b"}, ("p", "dev"): {"c"}, ("p", "test"): {None}, ("q", "dev"): {None}, ("q", None): {"d"}, ("p", ""): {"a", "b", "c"}, ("z", "dev"): {None}, (None, "dev"): {None}}
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, catalog.takes(wants.repartition(3), files.repartition(2), "k").collect()), key=str)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ({"turns": [{"speaker": "A", "start": 1, "end": "2.5"}]}, [("A", 1.0, 2.5)]), ({"turns": [], "turns_meta": [{"spk": "B", "t_start": 0.5}]}, [("B", 0.5, None)]),
        ([{"speaker": None, "voice_id": "v", "t_start_s": None, "start_time_seconds": 3}, "odd"], [("v", 3.0, None), (None, None, None)]), ({"turns": 7}, None), ({"turns": []}, None), ([], None), ("text", None), (None, None),
    ],
)
def test_turns_of_all_forms(spark, raw, want):
    df = spark.createDataFrame([(None if raw is None else json.dumps(raw),), ("{cut",)], "t string").coalesce(1)
    found = df.select(alignment.read_turns(F.col("t")).alias("r")).collect()
    assert (found[0]["r"] and [tuple(t) for t in found[0]["r"]]) == want and found[1]["r"] is None


def test_turn_files(spark, tmp_path):
    (tmp_path / "s 1.json").write_text('{"turns": [{"speaker": "A", "start": 0, "end": 1}]}')
    (tmp_path / "s2.meta.json").write_text('{"turns_meta": [{"speaker": "B"}]}')
    (tmp_path / "s3.json").write_text("broken")
    read = lambda suffix: {r["scenario_id"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in tables.turn_files(spark, str(tmp_path), suffix).collect()}
    assert read(".json") == {"s 1": [("A", 0.0, 1.0)], "s3": None} and read(".meta.json") == {"s2": [("B", None, None)]}
    timed = spark.createDataFrame([([(None, 1.0)],), ([(None, None)],), (None,)], "t array<struct<start:double,end:double>>")
    assert [r[0] for r in timed.select(alignment.is_timed(F.col("t"))).collect()] == [True, False, False]


@pytest.mark.parametrize("width", [0.3, 5.0])
def test_overlaps_against_all_pairs(spark, width):
    random = np.random.default_rng(3)
    spans = lambda n, long: [(int(k), i, float(s), float(s + l)) for i, (k, s, l) in enumerate(zip(random.integers(0, 3, n), random.uniform(-50, 50, n), random.exponential(long, n)))]
    a, b = spans(150, 2.0) + [(0, 900, -1000.0, 1000.0), (1, 901, 5.0, 5.0), (1, 902, 9.0, 3.0), (None, 903, 0.0, 9.0)], spans(150, 0.2) + [(0, 800, 10.0, 10.0 + 2.0**-20), (2, 801, None, 5.0), (0, 802, -2000.0, 3000.0)]
    left = spark.createDataFrame(a, "k int, i int, a_start double, a_end double")
    right = spark.createDataFrame(b, "k int, j int, b_start double, b_end double")
    found = [(r["i"], r["j"], round(r["shared"], 9)) for r in placement.overlaps(left, right, "k", width).collect()]
    want = [(i, j, round(min(e, f) - max(s, t), 9)) for k, i, s, e in a for m, j, t, f in b if k is not None and k == m and None not in (s, e, t, f) and s < e and t < f and s < f and t < e]
    assert sorted(found) == sorted(want) and len(want) > 200
    assert placement.overlaps(left.where("false"), right, "k", width).count() == 0


def test_overlaps_are_joined_by_sorting(spark):
    left = spark.range(300).select((F.col("id") % 5).alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("a_start"), (F.col("id") + 3.0).alias("a_end"))
    right = spark.range(300).select((F.col("id") % 50).alias("k"), F.col("id").alias("j"), F.col("id").cast("double").alias("b_start"), (F.col("id") + 40.0).alias("b_end"))
    found = placement.overlaps(left, right, "k", 1.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "_bin" in x] and "LeftSemi" in plan
    assert found.count() == sum(i % 5 == j % 50 and i < j + 40 and j < i + 3 for i in range(300) for j in range(300))


def test_turn_overlaps_reads_events_once(spark, tmp_path):
    spark.sql("SELECT 7L AS event_id, 3L AS user_id, timestamp_micros(1704097200000000 + k * 10000000) AS ts, 2.0D AS value FROM (SELECT explode(array(0L, 1L)) AS k)").write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT 3L AS conv_id, 0L AS turn, 'user' AS role, repeat('x', 800000) AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(r["shared"] for r in QUERIES["turn_overlaps"](spark, str(tmp_path)).collect()) == [120.0, 120.0]


def test_spaced_turns_by_hand(spark):
    # cut at 1.0; a pause of 0.5 behind it: the second turn starts at 1.5 and ends with the audio, at 4.5.
    schema = "k int, t int, start double, end double, length double"
    rows = [(1, 0, 0.5, 1.0, 4.0), (1, 1, 3.0, 4.0, 4.0), (2, 0, 0.0, 2.0, 4.0), (2, 1, 2.0, 1.0, 4.0), (2, 2, 2.0, 3.0, 4.0), (3, 0, 0.0, 9.0, 4.0), (3, 1, 1.0, 8.0, 4.0), (3, 2, 1.0, None, 4.0), (4, 0, 1.0, 2.0, 4.0), (5, 0, 0.0, None, 4.0), (5, 1, 1.0, 2.0, 4.0)]
    found = placement.spaced_turns(spark.createDataFrame(rows, schema), "k", "t", "start", "end", "length", 0.5, 0.5)
    got = {(r["k"], r["t"]): (r["gap"], r["new_start"], r["new_end"]) for r in found.collect()}
    assert got == {
        (1, 0): (0.5, 0.0, 1.0), (1, 1): (0.0, 1.5, 4.5), (2, 0): (0.0, 0.0, 2.0), (2, 1): (0.0, 2.0, 1.0), (2, 2): (0.0, 2.0, 3.0),
        (3, 0): (0.5, 0.0, 4.0), (3, 1): (0.5, 4.5, 4.5), (3, 2): (0.0, 5.0, 5.0), (4, 0): (0.0, 1.0, 2.0), (5, 0): (0.0, 0.0, None), (5, 1): (0.0, 1.0, 2.0),
    }


def test_silence_at_quiet_places(spark):
    x = [1.0, 1.0, 0.1, 1.0, 1.0, 1.0, 0.2, 1.0]
    df = spark.createDataFrame([(x, [3, 6], [2, 0]), (x, [], []), ([], [], []), (None, [1], [1])], "x array<double>, b array<int>, g array<int>")
    rows = df.withColumn("c", signal.cuts_near(2, 50)("x", "b")).withColumn("y", placement.with_silence(F.col("x"), F.col("c"), F.col("g"))).collect()
    assert rows[0]["c"] == [2, 6] and rows[0]["y"] == [1.0, 1.0, 0.0, 0.0, 0.1, 1.0, 1.0, 1.0, 0.2, 1.0]
    assert rows[1]["y"] == x and rows[2]["y"] == [] and rows[3]["c"] is None and rows[3]["y"] is None


def test_grounding_items_by_hand(spark):
    event = "event_id string, start_s double, level_lufs double, reaction string"
    kind = f"array<struct<{', '.join(x.replace(' ', ':') for x in event.split(', '))}>>"
    base = spark.createDataFrame([("s", "park", -30.0, "/a/s.wav", [("x", 1.0, -20.0, "verbal"), ("y", 2.0, None, "pivot")]), ("t", "park", None, "/a/t.wav", [("x", 1.0, -20.0, "verbal")])], f"scenario_id string, scene string, bed double, audio string, events_placed {kind}")
    silent = "array<struct<event_id:string,start_s:double,muted:boolean>>"
    muted = [
        ("s", 1, "yard", "/b/s.wav", [("x", 1.0, None), ("y2", 2.5, True)]), ("t", 0, "park", "/c/t.wav", [("x", 1.0, False), ("y", 2.0, True)]), ("s", 0, "park", "/c/s.wav", [("x", None, True)]),
        ("u", 0, "park", "/c/u.wav", [("x", 1.0, True)]), ("s", 2, "park", "/d/s.wav", [("x", 1.0, False)]), ("t", 3, "park", "/e/t.wav", None),
    ]
    found = items.grounding_items(base, spark.createDataFrame(muted, f"scenario_id string, rank int, scene string, audio string, events_placed {silent}")).collect()
    assert sorted(tuple(r) for r in found) == [
        ("s::pair::1::muted", "s::pair::1", "s", "yard", "/b/s.wav", "y2", 2.0, None, "pivot", False), ("s::pair::1::present", "s::pair::1", "s", "yard", "/a/s.wav", "y2", 2.0, None, "pivot", True),
    ]


def test_attempts_of_all_scenarios_count(spark):
    steps = spark.createDataFrame([("a", "r1", 2, "accepted", True, None), ("b", "r1", 6, "abandoned", None, True), ("c", "r2", 0, "regenerate", False, True)], "id string, stratum string, n_attempts long, state string, has_rare boolean, has_pivot boolean")
    first = spark.createDataFrame([("a", True), ("b", True)], "id string, accepted boolean")
    got = {r["stratum"]: (r["n"], r["n_accepted"], r["n_first_try"], r["mean_attempts"]) for r in filtering.stratum_acceptance(steps, first, "id", "stratum").collect()}
    assert got == {"r1": (2, 1, 1, 4.0), "r2": (1, 0, 0, 0.0)}
    report = filtering.regeneration_report(steps, spark.createDataFrame([("a", 2), ("z", 1), ("b", None)], "id string, n_rescued int"), "id").first()
    assert (report["n"], report["n_accepted"], report["n_regenerate"], report["n_abandoned"], report["n_rescued"]) == (3, 1, 1, 1, 3)
    assert (report["n_rare"], report["rare_rate"], report["n_usual"], report["n_usual_accepted"], report["n_pivot"], report["pivot_rate"]) == (1, 1.0, 2, 0, 2, 0.0)


def test_what_was_not_evaluated_is_left_out(spark):
    kind = "id string, subject_cos double, pairs array<struct<gold:string,pred:string>>, n_sounds long, n_missing long, n_spurious long, reactions_ok boolean"
    rows = [("none", None, None, None, None, None, None), ("deaf", None, [], 2, 0, 0, False), ("quiet", None, [], 0, 0, 0, True), ("half", 0.4, [("pivot", "pivot"), ("verbal", "missing")], 2, 1, 0, False), ("right", 0.8, [("ambient", "ambient")], 1, 0, 3, True)]
    scenarios = spark.createDataFrame([(r[0],) for r in rows] + [("unknown",)], "id string")
    kept = filtering.evaluated(scenarios, spark.createDataFrame(rows, kind), "id")
    assert {r["id"] for r in kept.collect()} == {"quiet", "half", "right"}
    got = filtering.recovery_metrics(kept, 0.5, ("pivot", "verbal", "behavioral", "ambient")).first()
    assert (got["n"], got["n_sounds"], got["n_typed"], got["n_missing"], got["n_spurious"], got["n_subjects"]) == (3, 3, 2, 1, 3, 2)
    assert got["sound_accuracy"] == pytest.approx(2 / 3) and got["mean_cosine"] == pytest.approx(0.6) and got["topic_rate"] == pytest.approx(1 / 3) and got["reaction_rate"] == pytest.approx(2 / 3) and got["accept_rate"] == pytest.approx(1 / 3)
