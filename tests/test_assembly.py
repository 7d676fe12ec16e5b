"""Finished records on literal frames; expected values are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from parlance.operators import assembly, records
from parlance.sources.tables import SCENARIO

TIMELINE = "scenario_id string, timeline array<struct<type:string,speaker:string,text:string,event_id:string>>"


def test_final_dialogues(spark):
    event = lambda i, reaction: (i, reaction, None, None, None)
    made = {"scenario_id": "s1", "template_id": "t", "category": "c", "theme": "Tea", "scene": "hall", "subject": " a b ", "gender_a": "F", "gender_b": "", "role_a": "host", "role_b": "guest", "split": "", "events": [event("x/a", "pivot"), event("x/b", "ambient"), event("", "verbal")]}
    rows = spark.createDataFrame([{f.name: made.get(f.name) for f in SCENARIO}, {f.name: {"scenario_id": "s2"}.get(f.name) for f in SCENARIO}, {f.name: {"scenario_id": "s3"}.get(f.name) for f in SCENARIO}], SCENARIO)
    dialogues = spark.createDataFrame([("s1", [("utterance", "A", "Hi", None), ("", "B", "Yes", None), (None, None, None, "x/a"), ("utterance", "A", "Bye", None), ("pause", None, None, None)]), ("s2", None), ("lost", [])], TIMELINE)
    found = {r["scenario_id"]: r for r in assembly.final_dialogues(records.normalised(rows), dialogues).collect()}
    assert set(found) == {"s1", "s2"}
    a, b = found["s1"], found["s2"]
    assert [a[c] for c in ("n_turns_total", "n_turns_a", "n_turns_b", "n_events_in_timeline", "n_events", "n_reacted_to", "n_pivot", "subject", "gender_a", "gender_b", "split")] == [3, 2, 1, 1, 2, 1, 1, "a b", "F", None, None]
    assert [i["type"] for i in a["timeline"]] == ["utterance", "utterance", "event", "utterance", "pause"]
    assert (b["timeline"], b["n_turns_total"], b["n_events"]) == ([], 0, 0)


def test_batch_results(spark):
    results = spark.createDataFrame([("c1", "succeeded", "{}", None, None), ("c2", "errored", "x", "overloaded", "e" * 500), ("c3", "errored", None, "", None), ("c4", "expired", None, None, None), ("c5", None, None, None, None)], "custom_id string, kind string, reply string, error_type string, error string")
    sent = spark.createDataFrame([("c1", "i1"), ("c2", "i2"), ("c9", "i9")], "custom_id string, item_id string")
    found = {r["item_id"]: (r["status"], r["reply"], r["note"] and len(r["note"])) for r in assembly.batch_results(results, sent).collect()}
    assert found == {"i1": ("batch:succeeded", "{}", None), "i2": ("batch:errored:overloaded", None, 400), "c3": ("batch:errored:unknown", None, None), "c4": ("batch:expired", None, None), "c5": ("batch:unknown", None, None)}


@pytest.mark.parametrize(("message", "name"), [("{'code': 1, 'param': 'top_p', 'x': 'y'}", "top_p"), ("'param':  \"seed\"}", "seed"), ("'param': None, 'a': 'b'", None), ("'param': ''", None), ("'param': 'open", None), ("no", None), (None, None)])
def test_rejected_parameter(spark, message, name):
    assert spark.range(1).select(assembly.rejected_parameter(F.lit(message).cast("string")).alias("x")).first()["x"] == name


def test_master_levels_and_audio(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "scenario_id string")
    kept = spark.createDataFrame([("a", '{"master_input_lufs": -21.5, "master_limiter_gain": 1}'), ("b", '{"master_input_lufs": "loud", "master_limiter_gain": "-3"}')], "scenario_id string, processing string")
    assert sorted(map(tuple, assembly.master_levels(rows, kept).collect())) == [("a", -21.5, 1.0), ("b", None, None), ("c", None, None)]
    files = spark.createDataFrame([("/x/a.mp3",), ("/x/a.mp3",), (None,)], "path string")
    declared = spark.createDataFrame([("a", "/x/a.mp3"), ("b", "/x/b.mp3"), ("c", None)], "scenario_id string, audio string")
    assert sorted((r["scenario_id"], r["path"]) for r in assembly.declared_audio(declared, files, "/y/").collect()) == [("a", "/x/a.mp3"), ("b", "/y/b.wav"), ("c", "/y/c.wav")]
