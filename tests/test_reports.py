"""Reports, replies' lists and subjects, voices' own events and shapes of signals; expected values are worked out by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import levels, signal, text
from parlance.functions.loose_json import list_in
from parlance.operators import assembly, cache, catalog, placement, quota, records, timeline, verdicts


def column(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ([1], [1]), ({"items": [2], "list": [3]}, [2]), ({"list": [3], "z": [4]}, [3]), ({"z": [4], "n": "[5]"}, [4]), ({"y": [4], "z": [5]}, None), ({"n": 1}, None), ({"items": None, "list": [6]}, [6]), ("text", None), (None, None),
    ],
)
def test_lists_in_replies(spark, value, want):
    got = column(spark, None if value is None else json.dumps(value), lambda c: list_in(c, ("items", "list")))
    assert (got and json.loads(got)) == want


@pytest.mark.parametrize(("subject", "want"), [(None, "empty subject"), ("  \n", "empty subject"), ("a b c", "subject too short"), ("a b c d", None), ("w " * 60, None), ("w " * 61, "subject too long")])
def test_subjects(spark, subject, want):
    assert column(spark, subject, text.subject_fault) == want


@pytest.mark.parametrize(("raw", "prompt", "want"), [("p end. yes", "a p end.", "p end. yes"), ("x a p end. n a p end.\n yes", "a p end.", "yes"), ("yes", "", "yes"), ("yes", None, "yes"), (None, "p", None), ("Q" * 60 + " ok", "W" + "Q" * 60, "ok")])
def test_behind_the_prompt(spark, raw, prompt, want):
    df = spark.createDataFrame([(raw, prompt)], "r string, p string")
    assert df.select(text.after_prompt(F.col("r"), F.col("p"))).first()[0] == want


def test_behavioural_ids(spark):
    event = lambda **x: x
    record = {
        "core_elements": [event(event_id="a", kind="Behavioral "), event(id="b", is_behavioral=True), event(event_id="", sound_id="c", behavioral=True), "odd", event(event_id="no", is_behavioral="true"), event(nature="behavioural")],
        "elements": 5, "events": [event(event_id="a", reaction="behavioral")], "others": [event(event_id="x", kind="behavioral")],
        "timeline": [event(type="event", event_id="t", label="behavioral"), event(type="utterance", event_id="u", label="behavioral")],
    }
    assert column(spark, json.dumps(record), placement.behavioural_ids) == ["a", "b", "c", "t"]
    assert column(spark, "[]", placement.behavioural_ids) == [] and column(spark, None, placement.behavioural_ids) == []


def test_voices_own_events(spark):
    events = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a"), ("u", "a"), (None, "a")], "k string, event_id string")
    metas = [("s", json.dumps({"events_rendered_as_tags": [{"event_id": "a"}, {"event_id": ""}, 7]})), ("t", '{"events_rendered_as_tags": {}}'), ("u", "broken")]
    left = placement.not_voiced(events, spark.createDataFrame(metas, "k string, meta string"), "k").collect()
    assert sorted(map(tuple, left), key=str) == sorted([("s", "b"), ("t", "a"), ("u", "a"), (None, "a")], key=str)
    made = lambda meta: column(spark, meta, placement.is_synthesized)
    assert [made(m) for m in ('{"x": 1}', '{"dry_run": true}', '{"dry_run": false}', "[]", "{broken", None)] == [True, False, True, False, False, False]


def test_speakers_and_gaps(spark):
    df = spark.createDataFrame([(1, 0, "A"), (1, 1, "A"), (1, 2, "B"), (1, 3, None), (1, 4, None), (2, 0, "A")], "k int, t int, s string")
    assert [r["same_across"] for r in placement.same_speaker_across(df, "k", "t", "s").orderBy("k", "t").collect()] == [True, False, False, True, True, True]
    assert placement.least_gap(0.3, 0.15, 0.35, True) == 0.5 and placement.least_gap(0.3, 0.15, 0.35, False) == 0.3


def test_synthesis_plans(spark):
    df = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, "bb"), (1, 2, "ccccc"), (2, 0, "z" * 9)], "k int, t int, x string")
    found = {r["k"]: (r["n_inputs"], r["total_chars"], r["n_chunks"], r["chunk_ranges"]) for r in timeline.synthesis_plans(df, "k", "t", "x", 6).collect()}
    assert found == {1: (3, 11, 2, [[0, 2], [2, 3]]), 2: (1, 9, 1, [[0, 1]])}


def test_cache_verdicts(spark):
    items = spark.createDataFrame([(t, i, "x") for t in "abcd" for i in range(3)], "task string, id int, gold string")
    kind = "task string, id int, gold string, error boolean, run map<string,string>"
    rows = [("a", i, "x", False, {"m": "1"} if i else None) for i in range(3)] + [("b", 0, "x", True, None), ("b", 1, "y", False, None), ("b", 9, "x", False, None)] + [("c", i, "x", i == 2, {"m": str(i)}) for i in range(3)]
    run = lambda tolerate: {r["task"]: (r["n_items"], r["n_cached"], r["n_missing"], r["n_intruders"], r["n_divergent"], r["n_errors"], r["n_settings"], r["verdict"]) for r in cache.task_verdicts(items, spark.createDataFrame(rows, kind), "task", "id", ["gold"], "error", "run", tolerate).collect()}
    assert run(True) == {"a": (3, 3, 0, 0, 0, 0, 1, "ok"), "b": (3, 3, 1, 1, 1, 1, 0, "refused"), "c": (3, 3, 0, 0, 0, 1, 3, "refused"), "d": (3, 0, 3, 0, 0, 0, 0, "no cache")}


def test_mentions(spark):
    gold = [("a", "pivot", False), ("b", "", False), ("c", "verbal", True)]
    rows = [("s", 25, "text", ["a"], gold), ("s", 75, None, ["a", "c"], gold), ("s", 200, None, None, gold), ("t", 25, "", [], gold)]
    df = spark.createDataFrame(rows, "scenario_id string, budget int, summary string, mentioned array<string>, gold array<struct<name:string,reaction:string,is_rare:boolean>>")
    assert {r["budget"]: (r["n_sounds"], r["n_mentioned"], r["mention_rate"]) for r in verdicts.mention_rates(df).collect()} == {25: (4, 1, 0.25), 75: (2, 2, 1.0)}
    assert {r["n_budgets"]: (r["n"], r["mention_rate"], r["budgets_per_mentioned"]) for r in verdicts.mentions_over_budgets(df).collect()} == {0: (2, 0.5, 1.5), 1: (1, 0.5, 1.5), 2: (1, 0.5, 1.5)}


def test_a_summary_without_a_verdict_has_none(spark):
    gold = "array<struct<name:string>>"
    rows = spark.createDataFrame([(1, "a dog barked", [("dog",)]), (2, "a dog barked", [("dog",)])], f"item_id int, summary string, gold {gold}")
    told = spark.createDataFrame([(1, '[{"sound": "dog", "verdict": "heard", "evidence": "dog barked"}]'), (3, "[]")], "item_id int, verdicts string")
    found = {r["item_id"]: r["judged"] for r in verdicts.judged_summaries(rows, told).collect()}
    assert found[1]["heard"] == ["dog"] and found[2] is None and len(found) == 2


def test_splits_report(spark):
    rows = spark.createDataFrame([("s1", "train", "t1", "h", "x", "P1", True), ("s2", "train", "t1", "h", "y", "P0", False), ("s3", "train", "t2", "h", "x", "P0", False), ("s4", "dev", "t3", "g", "x", "P0", False)], "scenario_id string, split string, template_id string, theme string, scene string, composition string, has_rare_event boolean")
    events = spark.createDataFrame([("s1", "pivot"), ("s1", "verbal"), ("s2", "verbal"), ("s9", "pivot")], "scenario_id string, reaction string")
    found = {r["split"]: r for r in quota.dataset_split_report(rows, events).collect()}
    a, b = found["train"], found["dev"]
    assert (a["n_scenarios"], a["n_templates"], a["n_themes"], a["n_rare"], a["n_scenes"], a["least_scene"], a["most_scene"], a["n_compositions"], a["least_composition"], a["most_composition"]) == (3, 2, 1, 1, 2, 1, 2, 2, 1, 2)
    assert (a["n_events"], a["n_pivot"], a["n_verbal"], a["n_ambient"]) == (3, 1, 2, 0) and a["share_verbal"] == pytest.approx(2 / 3)
    assert (b["n_events"], b["share_pivot"], b["n_scenes"]) == (0, None, 1)


def test_audit(spark):
    rows = [("train", [("a",), ("b",)], "bed"), ("dev", [("a",), (None,)], "bed2"), ("test", None, "bed"), ("train", [("a",)], None), ("", [("a",)], "x"), (None, [], None)]
    found = quota.audited_sources(spark.createDataFrame(rows, "split string, events_placed array<struct<source_file:string>>, background_source string")).collect()
    assert sorted((r["source"] or "", r["splits"], r["n"]) for r in found) == [("", [], 2), ("a", ["dev", "train"], 3), ("bed", ["test", "train"], 2)]


def test_rare_exclusions(spark):
    forbidden = spark.createDataFrame([("boom", "park"), ("boom", "moon"), ("bang", "park")], "event string, scene string")
    rare, scenes = spark.createDataFrame([("boom",)], "event string"), spark.createDataFrame([("park",)], "scene string")
    assert sorted(tuple(r) for r in catalog.rare_faults(forbidden, rare, scenes).collect()) == [("bang", "park", "unknown event"), ("boom", "moon", "unknown scene")]
    assert catalog.rare_faults(forbidden, rare.where("event = 'x'"), scenes).count() == 0


def test_rooms_and_biased_distances(spark):
    df = spark.createDataFrame([("a", "train", "pivot"), ("a", None, "verbal"), ("a", "", None)], "scene string, split string, r string")
    rows = df.select(levels.room_variation("scene", "split").alias("room"), levels.drawn_distance(F.lit(1.0), F.lit(11.0), F.lit(0.5), levels.by_reaction(F.col("r"), {"pivot": 0.2, "verbal": 9.0})).alias("m")).collect()
    assert all(low <= x <= high for x, (low, high) in zip(rows[0]["room"], levels.ROOM_RANGES)) and rows[1]["room"] == rows[2]["room"] == [1.0] * 3
    assert [r["m"] for r in rows] == [2.0, 6.0, 6.0]


def test_windows_and_impulses():
    x = np.arange(10.0)
    assert signal.window_or_loop(x, 4, 0.0, 2, 1).tolist() == [2, 3, 4, 5] and signal.window_or_loop(x, 4, 0.99, 2, 1).tolist() == [4, 5, 6, 7]
    assert signal.window_or_loop(x, 8, 0.99, 2, 1).tolist() == list(range(2, 10)) and len(signal.window_or_loop(x, 25, 0.5, 2, 1)) == 25
    impulse = np.array([0.0, 0.1, -1.0, 0.5])
    assert signal.aligned(impulse, 100).tolist() == [-1.0, 0.5] and signal.aligned(impulse, 20).tolist() == impulse.tolist() and len(signal.aligned(np.zeros(0))) == 0


def test_layers_of_events_and_elements(spark):
    kind = "k int, events array<struct<event_id:string,is_rare:boolean>>, core_elements array<struct<event_id:string,nature:string>>, supporting_elements array<struct<event_id:string,nature:string>>"
    sound, other = "acoustic_event", "person"
    rows = [
        (1, [("a", True), ("rare_events/b", None), ("", False), (None, True), ("a", False)], [("c", sound), ("rare_events/d", sound), ("e", other), ("a", sound)], [("f", sound), ("rare_events/g", sound), ("c", sound), ("", sound)]),
        (2, None, None, None), (3, [(f"x{i}", False) for i in range(200)], [], []),
    ]
    found = {r["k"]: r for r in quota.layer_sets(spark.createDataFrame(rows, kind), "k").collect()}
    assert (found[1]["core"], found[1]["supporting"], found[1]["rare"]) == (["c"], ["c", "f", "rare_events/g"], ["a", "rare_events/b", "rare_events/d"])
    assert (found[2]["core"], found[2]["supporting"], found[2]["rare"]) == ([], [], [])
    assert not set(found[3]["core"]) & set(found[3]["supporting"]) and len(found[3]["core"]) + len(found[3]["supporting"]) == 200 and 40 < len(found[3]["supporting"]) < 100


def test_flat_templates(spark):
    rows = [("at home", "tea time", [("T1", "d1"), ("T2", None)]), ("x", None, [("T", "d")]), ("y", "z", []), ("y", "w", None)]
    found = records.flat_templates(spark.createDataFrame(rows, "category string, theme string, templates array<struct<title:string,description:string>>")).collect()
    assert sorted(tuple(r)[0] for r in found) == ["at_home__tea_time__01", "at_home__tea_time__02", "x____01"]
    assert {(r["title"], r["index"], r["description"]) for r in found} == {("T1", 1, "d1"), ("T2", 2, None), ("T", 1, "d")}


def test_finished_dataset(spark):
    normal = spark.createDataFrame([("s", "park", "a", "b", "x", True, "t1", "c", "", "label")], "scenario_id string, scene string, role_a string, role_b string, subject string, has_rare boolean, template_id string, category string, split string, theme_label string").withColumn("events", F.array())
    told = spark.createDataFrame([("s", "line", "", '{"title": "T"}', "dev"), ("u", "line", "own", '{"title": "T"}', "")], "scenario_id string, timeline string, category string, theme string, split string")
    found = {r["scenario_id"]: r for r in assembly.finished_dataset(told, normal).collect()}
    assert [found["s"][c] for c in ("scene", "has_rare_event", "template_id", "category", "theme_label", "split", "metadata")] == ["park", True, "t1", "c", "label", "dev", None]
    assert [found["u"][c] for c in ("scene", "has_rare_event", "template_id", "category", "theme_label", "split")] == [None, False, None, "own", "T", None]


def test_splits_of_scenarios_are_not_broadcast(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "train", "t1", "h", "x", "P1", True)], "scenario_id string, split string, template_id string, theme string, scene string, composition string, has_rare_event boolean")
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    found = quota.dataset_split_report(rows, rows.select("scenario_id", F.lit("pivot").alias("reaction")))
    assert "BroadcastHashJoin [scenario_id" not in found._jdf.queryExecution().executedPlan().toString()
