"""Spoken turns on literal frames; expected values are worked out by hand."""

import json

import pytest

from pyspark.sql import functions as F

from parlance.operators import alignment, filtering
from parlance.queries import QUERIES
from parlance.sources import tables


def listed(df):
    return sorted(map(tuple, df.collect()))


def test_words_and_offsets_without_tags(spark):
    turns = spark.createDataFrame([(1, 0, "[sighs] Don't go!"), (1, 1, "\U0001f600 a  B"), (1, 2, ""), (1, 3, None), (1, 4, "[laughs] 12")], "k int, t int, text string")
    assert listed(alignment.word_table(turns, "k", "t", "text")) == [(1, 0, 0, "don't", 0), (1, 0, 1, "go", 6), (1, 1, 0, "a", 2), (1, 1, 1, "b", 5)]


def test_turns_meet_halfway_and_fill_the_audio(spark):
    words = spark.createDataFrame([(1, 0, 0, 0.5, 1.0), (1, 0, 1, 1.0, 2.0), (1, 2, 0, 3.0, 3.5), (2, 0, 0, 1.0, 4.0)], "k int, t int, position int, start double, end double")
    lengths = spark.createDataFrame([(1, 9.0)], "k int, duration double")
    assert listed(alignment.turns_from_words(words, lengths, "k", "t")) == [(1, 0, 0.0, 2.5), (1, 2, 2.5, 9.0), (2, 0, 0.0, 4.0)]


def test_first_source_with_turns(spark):
    schema = "k int, turns array<string>"
    sources = {"a": spark.createDataFrame([(1, []), (2, ["x"]), (4, None)], schema), "b": spark.createDataFrame([(1, ["y"]), (2, ["z"]), (3, [])], schema)}
    assert [(r["k"], r["source"], r["turns"]) for r in alignment.by_source(sources, "k").orderBy("k").collect()] == [(1, "b", ["y"]), (2, "a", ["x"])]


def test_voices_keep_gender_and_differ(spark):
    pool = spark.createDataFrame([("f1", "f"), ("m1", "m"), ("m2", "m"), ("", "f"), (None, "f")], "voice_id string, gender string")
    scenes = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([("f", "m"), ("f", "f"), ("m", "m"), (None, "f"), ("x", "f")] * 10)], "k int, gender_a string, gender_b string")
    for r in alignment.voices_for(scenes, pool, "k").collect():
        assert r["voice_a"] != r["voice_b"] and {r["voice_a"], r["voice_b"]} <= {"f1", "m1", "m2"}
        if r["gender_a"] in ("f", "m"):
            assert r["voice_a"][0] == r["gender_a"]
        if (r["gender_a"], r["gender_b"]) in (("f", "m"), ("m", "m")):
            assert r["voice_b"][0] == "m"
    with pytest.raises(Exception, match="voice pool"):
        alignment.voices_for(scenes, pool.where("voice_id = 'f1'"), "k").collect()
    with pytest.raises(Exception, match="voice pool"):
        alignment.voices_for(scenes, pool.where("false"), "k").collect()


def test_speakers_meet_at_their_mean(spark):
    parts = spark.createDataFrame([(1, "A", 50.0, 100), (1, "A", 50.0, 100), (1, "A", 50.0, 0), (1, "B", 1.0, 100), (1, None, 9.0, 9), (2, "A", 5.0, 5), (3, "A", 1.0, 1), (3, "B", 1e-6, 1)], "k int, who string, e double, n int")
    found = {(r["k"], r["who"]): r["gain"] for r in alignment.speaker_gains(parts, "k", "who", "e", "n").collect()}
    assert found[2, "A"] == 0 and found[3, "A"] == -12 and found[3, "B"] == 12
    assert found[1, "A"] == pytest.approx(-8.4949, abs=1e-3) and found[1, "B"] == pytest.approx(8.4949, abs=1e-3)


def test_listed_ids_leave_the_store(spark, tmp_path):
    stored = spark.createDataFrame([("1", "x"), ("2", "y"), (None, "z")], "scenario_id string, v string")
    for name, held, kept in (("list", ["1", "", None, "1"], "yz"), ("map", {"2": {"a": 1}}, "xz"), ("number", 7, "xyz")):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(held))
        found = filtering.without(stored, tables.listed_ids(spark, str(path)), "scenario_id")
        assert "".join(sorted(r["v"] for r in found.collect())) == kept


def test_words_start_at_characters(spark):
    rows = spark.createDataFrame([(0, "it's \U0001f600 a b"), (1, ""), (2, None), (3, "é ab")], "i int, said string")
    assert [r["s"] for r in rows.orderBy("i").select(alignment.word_starts(F.col("said")).alias("s")).collect()] == [[0, 7, 9], [], [], [2]]


def test_resume_offsets_stay_within_their_rows(spark):
    found = QUERIES["resume_offsets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in found and "Generate" not in found
