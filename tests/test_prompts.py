"""Prompts, placements and small helpers on literal frames; expected values are worked out by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import signal
from parlance.operators import items, placement, prompts, quota
from parlance.sources import tables

ITEM = "array<struct<type:string,speaker:string,text:string,event_id:string>>"
EVENT = "array<struct<event_id:string,reaction:string,is_rare:boolean,slot:string,register:string>>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_transcript_keeps_order_and_drops_other_types(spark):
    timeline = [("utterance", "A", "Hi [sighs] you", None), ("event", None, None, "e/dog"), ("pause", "B", "never", None), ("event", None, None, "e/dog"), ("utterance", "B", None, None), (None, None, None, "e/x"), ("event", None, None, "")]
    rows = {r["k"]: r for r in spark.createDataFrame([(1, timeline), (2, []), (3, None)], f"k int, t {ITEM}").select("k", prompts.transcript(F.col("t")).alias("said"), prompts.heard_ids(F.col("t")).alias("heard")).collect()}
    assert rows[1]["said"] == "A: Hi [sighs] you\n[SOUND: e/dog]\n[SOUND: e/dog]\nB: \n[SOUND: ]" and rows[1]["heard"] == ["e/dog"]
    assert (rows[2]["said"], rows[2]["heard"]) == ("", []) and (rows[3]["said"], rows[3]["heard"]) == ("", None)


def test_templates_are_read_once(spark):
    assert one(spark, prompts.filled_in("{{a}} {x}|{y}|{x}", x=F.lit("{y}"), y=F.lit(None))) == "{a} {y}||{y}"
    assert one(spark, prompts.filled_in("", x=F.lit("z"))) == ""
    with pytest.raises(KeyError):
        prompts.filled_in("{z}", x=F.lit(1))
    assert [tuple(m) for m in one(spark, prompts.messages(F.lit("s"), F.lit(None)))] == [("system", "s"), ("user", "")]


def test_bullets(spark):
    rows = spark.createDataFrame([(["a", None, "b"],), ([],), (None,)], "v array<string>").select(prompts.bullets(F.col("v"), 4, "    (none)").alias("x")).collect()
    assert [r["x"] for r in rows] == ["    - a\n    - b", "    (none)", "    (none)"]


def test_event_lines_with_registers(spark):
    known = spark.createDataFrame([("verbal", "calm", "ask", None), ("verbal", "calm", "zoom", ["[no]"]), ("pivot", "terse", "stop", ["[gasps]", "[sighs]"]), ("pivot", "mute", "", ["[coughs]"])], "reaction string, register string, move string, required_tags array<string>")
    events = [("x/dog", "verbal", None, "early", "calm"), ("x/bell", "pivot", True, "noon", "terse"), ("x/car", "pivot", False, "", "mute"), (None, None, None, None, None)]
    rows = spark.createDataFrame([(1, events), (2, []), (3, None)], f"k int, events {EVENT}")
    found = {r["k"]: r["event_lines"] for r in prompts.with_event_lines(rows, known, "  {register}: {move}", "  one of {tags}", none="nothing").collect()}
    assert found[2] == found[3] == "nothing"
    assert found[1].split("\n") == ["    - x/dog  →  VERBAL   [PLACEMENT: in the FIRST THIRD of the conversation]", "  calm: ask", "    - x/bell  →  PIVOT  (rare, disruptive)", "  terse: stop", "  one of [gasps], [sighs]", "    - x/car  →  PIVOT", "    -   →  "]
    none = prompts.with_event_lines(rows, known.where("false"), "{move}", "{tags}").where("k = 1").first()["event_lines"]
    assert none.count("\n") == 3 and none.startswith("    - x/dog  →  VERBAL")
    assert [r["x"] for r in rows.orderBy("k").select(prompts.pivot_of(F.col("events")).alias("x")).collect()] == ["x/bell", None, None]


@pytest.mark.parametrize(("start", "reveal", "said"), [(3.25, "none", "N"), (None, "time_id", "N"), (3.0, "time", "T 3.0"), (12.34, "time_id", "I 12.3 door slam")])
def test_revealed(spark, start, reveal, said):
    assert one(spark, prompts.revealed(F.lit(start).cast("double"), F.lit("x/door_slam"), F.lit(reveal), "N", "T {t}", "I {t} {name}")) == said


def test_clues(spark):
    rows = spark.createDataFrame([("In the BUSY kitchen a door slam, wonderful", "busy_kitchen", ["x/door_slam", "x/dog", "x/bus", None], "Wonderful, wonderful kitchen talk"), (None, None, None, None)], "r string, s string, e array<string>, d string")
    a, b = [r["c"] for r in rows.select(prompts.clues(F.col("r"), F.col("s"), F.col("e"), F.col("d")).alias("c")).collect()]
    assert (a["place"], a["sounds"], a["echoed"]) == ("busy kitchen", ["door slam"], ["kitchen", "wonderful"])
    assert (b["place"], b["sounds"], b["echoed"]) == (None, [], [])


def test_placements(spark):
    timeline = spark.createDataFrame([(1, 0, "event", "x/start"), (1, 1, "utterance", None), (1, 2, None, "x/lost"), (1, 3, "event", "rare_events/bang"), (1, 4, "utterance", None), (1, 5, "event", "x/two"), (1, 6, "event", "x/Cough_1"), (2, 0, "event", "x/two")], "k int, p int, type string, event_id string")
    events = spark.createDataFrame([(1, "x/start", "supporting", "ambient", None), (1, "rare_events/bang", "core", None, None), (1, "x/two", "supporting", None, True), (1, "x/two", "core", "verbal", None)], "k int, event_id string, layer string, reaction string, behavioural boolean")
    found = [tuple(r) for r in placement.event_placements(timeline, events, "k", "p").orderBy("k", "p").collect()]
    assert found == [
        (1, 0, "x/start", "supporting", None, False, "ambient"), (1, 3, "rare_events/bang", "rare", 0, False, None), (1, 5, "x/two", "core", 1, True, "verbal"),
        (1, 6, "x/Cough_1", "core", 1, True, None), (2, 0, "x/two", "core", None, False, None),
    ]


def test_shards_and_answers(spark):
    rows = spark.createDataFrame([(0,), (0,), (2,), (5,), (None,)], "shard long")
    assert sorted((r["shard"] if r["shard"] is not None else -1, r["n"]) for r in quota.shard_sizes(rows, 3).collect()) == [(-1, 2), (0, 2), (1, 0), (2, 1)]
    answers = spark.createDataFrame([(a,) for a in "bbaac"] + [(None,)] * 9, "answer string")
    assert [tuple(r) for r in items.frequent_answers(answers, 2).collect()] == [("a", 2), ("b", 2)]


def test_rare_duck():
    low, gain = 10 ** (-6 / 20), signal.rare_duck(200, np.array([0.1, np.nan]), 100)  # ramps of 5 and 40, 150 in all
    assert gain[[0, 9, 10]].tolist() == [1, 1, 1] and gain[14] == pytest.approx(low) and gain[12] == pytest.approx((1 + low) / 2)
    assert gain[119:121] == pytest.approx([low, low]) and gain[159] == pytest.approx(1) and gain[160] == 1
    assert signal.rare_duck(50, np.array([0.0, 0.1]), 100)[[4, 14]] == pytest.approx([low, low]) and (signal.rare_duck(5, np.array([9.0]), 100) == 1).all() and len(signal.rare_duck(0, np.array([0.0]), 100)) == 0


def test_formats(spark):
    names = spark.createDataFrame([("mp3_44100_128",), ("mp3_44100",), ("pcm_16000",), ("opus",), (None,)], "n string").select(signal.mp3_bitrate(F.col("n")).alias("b"), signal.sample_rate(F.col("n")).alias("r"))
    assert [tuple(r) for r in names.collect()] == [("128k", 44100), (None, 44100), (None, 16000), (None, None), (None, None)]
    assert one(spark, signal.pcm_seconds(F.lit(88200), F.lit(44100))) == 1.0


def test_themes_and_registers(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"topics": [{"category": "Home", "items": ["Tea", "Rain"]}, {"category": "Work", "items": []}, {"category": "Road", "items": ["Bus"]}]}, indent=1))
    (tmp_path / "r.json").write_text(json.dumps({"registers": {"pivot": [{"key": "a", "move": "m"}, {"key": "b", "required_tags": ["[x]"]}], "verbal": []}}))
    found = tables.themes(spark, str(tmp_path / "t.json")).orderBy("topic", "place").collect()
    assert [(r["topic"], r["place"], r["theme_key"]) for r in found] == [(0, 0, "Home::Tea"), (0, 1, "Home::Rain"), (2, 0, "Road::Bus")]
    assert sorted(map(tuple, tables.registers(spark, str(tmp_path / "r.json")).collect())) == [("pivot", 0, "a", "m", []), ("pivot", 1, "b", "", ["[x]"])]
