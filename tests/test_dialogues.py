"""Records, validation, verdicts, tags and allocation on literal frames; expected values are worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from parlance.functions import tags
from parlance.operators import items, quota, records, timeline, validation, verdicts
from parlance.plans import allocation
from parlance.sources import tables
from parlance.streaming import events as stream_events


def scenario(**own):
    return {"scenario_id": "s1", "template_id": "t", "events": [], **own}


def normal(spark, *rows):
    df = spark.read.schema(tables.SCENARIO).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    return [r.asDict(recursive=True) for r in records.normalised(df).orderBy("scenario_id").collect()]


def test_a_scenario_with_everything(spark):
    events = [{"event_id": "a/b", "reaction": "pivot", "is_rare": True, "register": "calm", "slot": "early"}, {"event_id": "", "reaction": "verbal"}, {"reaction": "ambient"}, {"event_id": "c/d", "reaction": "ambient", "register": ""}]
    (row,) = normal(spark, scenario(theme={"title": "T", "description": "D"}, role_a="x", role_b="y", subject=" talk ", events=events))
    assert [(e["event_id"], e["is_rare"], e["register"], e["slot"]) for e in row["events"]] == [("a/b", True, "calm", "early"), ("c/d", False, None, None)]
    assert (row["theme_title"], row["theme_description"], row["theme_label"], row["subject"], row["role_a"]) == ("T", "D", "T", "talk", "x")
    assert (row["n_events"], row["n_reacted_to"], row["stratum"], row["has_rare"], row["has_pivot"], row["has_rare_event"]) == (2, 1, "r1", True, True, True)


def test_scenarios_with_little(spark):
    rows = normal(spark, scenario(theme="plain", speakers={"A": "p", "B": "q"}, llm_output={"subject": "made"}, events=None), scenario(scenario_id="s2", theme={"title": "T"}, template_title="Own", has_rare_event=True, role_a="r"), scenario(scenario_id="s3"))
    assert [(r["theme_title"], r["theme_label"], r["role_a"], r["role_b"], r["subject"]) for r in rows] == [("plain", "plain", "p", "q", "made"), ("Own", "T", "r", None, ""), ("", None, None, None, "")]
    assert [(r["events"], r["has_rare"], r["has_rare_event"], r["stratum"]) for r in rows] == [([], False, False, "r0"), ([], True, True, "r0"), ([], False, False, "r0")]


def test_speakers(spark):
    df = spark.createDataFrame([(("a", "b"), "x", "y"), (("a", ""), "x", "y"), (None, "x", None)], "s struct<A:string,B:string>, a string, b string")
    assert [tuple(r[0]) for r in df.select(records.speakers_of(F.col("s"), F.col("a"), F.col("b"))).collect()] == [("a", "b"), ("x", "y"), ("x", None)]


def test_item_types(spark):
    df = spark.createDataFrame([("event", "A", "t", None), (None, "A", "t", None), ("x", None, None, "e"), ("x", "A", "t", "e"), (None, "A", None, None)], "type string, speaker string, text string, event_id string")
    assert [r[0] for r in df.select(records.item_type(*map(F.col, df.columns))).collect()] == ["event", "utterance", "event", "x", None]


LINES = ["Shall we go out today?", "I would like that a lot.", "The park is near.", "It may rain though.", "Then we take coats.", "Mine is at home.", "You can use mine.", "Thank you so much.", "Let us go now."]


def dialogue(changes=(), event_at=2, event="street/car_alarm", lines=LINES):
    out = [["utterance", "AB"[i % 2], line, None] for i, line in enumerate(lines)]
    out.insert(event_at, ["event", None, None, event])
    for i, change in changes:
        out[i] = change
    return [(1, i, *item) for i, item in enumerate(out)]


def reason(spark, rows, reaction="pivot", slot=None, event="street/car_alarm", tag=(), expected=True):
    found = spark.createDataFrame(rows, "k long, position long, type string, speaker string, text string, event_id string")
    want = spark.createDataFrame([(1, event, reaction, slot, list(tag))] if expected else [], "k long, event_id string, reaction string, slot string, tags array<string>")
    row = validation.validated(spark.createDataFrame([(1,)], "k long"), found, want, "k").first()
    assert row["valid"] == (row["reason"] is None)
    return row["reason"]


@pytest.mark.parametrize(
    ("want", "rows", "more"),
    [
        (None, dialogue(), {}),
        ("empty timeline", [], {}),
        ("invalid speaker", dialogue([(0, ["utterance", "C", "Hello there.", None])]), {}),
        ("empty text", dialogue([(0, ["utterance", "A", "  ", None])]), {}),
        ("semicolon", dialogue([(0, ["utterance", "A", "Well; no.", None])]), {}),
        ("tags only", dialogue([(0, ["utterance", "A", "[sighs]", None])]), {}),
        ("too long", dialogue([(0, ["utterance", "A", "word " * 61, None])]), {}),
        (None, dialogue([(0, ["utterance", "A", "word " * 60 + "[sighs deeply now]", None])]), {}),
        ("same speaker in a row", dialogue([(1, ["utterance", "A", "I would.", None])]), {}),
        ("missing event_id", dialogue(event=""), {}),
        ("unexpected event_id", dialogue(event="street/horn"), {}),
        ("invalid type", dialogue([(0, ["noise", None, None, None])]), {}),
        ("too few turns", dialogue(lines=LINES[:7]), {}),
        ("too many turns", dialogue(lines=LINES + LINES[1:8]), {}),
        (None, dialogue(lines=LINES + LINES[1:7]), {}),
        ("too many turns", dialogue(lines=LINES + LINES[1:7]), {"reaction": "ambient"}),
        ("inconsistent events", [r for r in dialogue() if r[2] == "utterance"], {}),
        ("duplicated events", [*dialogue(), (1, 99, "event", None, None, "street/car_alarm")], {}),
        ("pivot too late", dialogue(event_at=6), {}),
        (None, dialogue(event_at=5), {}),
        ("event outside its slot", dialogue(event_at=2), {"slot": "late", "reaction": "ambient"}),
        (None, dialogue(event_at=7), {"slot": "late", "reaction": "ambient"}),
        (None, dialogue([(0, ["utterance", "A", "Is that an alarm?", None])]), {}),
    ],
)
def test_reasons(spark, want, rows, more):
    assert reason(spark, rows, **more) == want


def test_one_speaker_alone(spark):
    rows = spark.createDataFrame([(1, i, "utterance", "A", "Well.", None) for i in range(2)], "k long, position long, type string, speaker string, text string, event_id string")
    none = spark.createDataFrame([], "k long, event_id string, reaction string, slot string, tags array<string>")
    assert validation.validated(spark.createDataFrame([(1,)], "k long"), rows, none, "k", least=2).first()["reason"] == "missing speakers"


def test_naming_needs_two_words(spark):
    event = "street/glass_breaking"
    assert reason(spark, dialogue([(0, ["utterance", "A", "Was that breaking glass?", None])], event=event), event=event) == "names the event"
    assert reason(spark, dialogue([(0, ["utterance", "A", "My glasses are breaking.", None])], event=event), event=event) is None


@pytest.mark.parametrize(
    ("text", "fault"),
    [
        ("I was just [voice breaks] about to leave.", None), ("I was about to leave.", "tag missing"), (None, "tag missing"), ("[voice breaks] I was about to leave.", "tag opens the turn"),
        ("[sighs] [voice breaks] I was.", "tag opens the turn"), ("I was about to [voice breaks]", "tag ends the turn"), ("I was. [voice breaks] About to leave.", "tag after a sentence"),
        ("I met Dr. [Voice Breaks] Brown today.", None), ("At 3. [voice breaks] I left.", None), ("I was... [voice breaks] about to leave.", "tag after an ellipsis"), ("I was [voice breaks] was about to leave.", "tag between equal words"),
    ],
)
def test_required_tags(spark, text, fault):
    df = spark.createDataFrame([(text, ["[voice breaks]", "[stammers]"])], "t string, tags array<string>")
    assert df.select(validation.tag_fault(F.col("t"), F.col("tags"))).first()[0] == fault


def test_delivery_is_confirmed_by_the_next_turn(spark):
    rows = [(k, *r[1:]) for k in (1, 2) for r in dialogue()]
    rows = [(k, i, t, s, "I was [gasps] going." if (k, i) == (1, 3) else x, e) for k, i, t, s, x, e in rows]
    df = spark.createDataFrame(rows, "k long, position long, type string, speaker string, text string, event_id string")
    want = spark.createDataFrame([(k, "street/car_alarm", ["[gasps]"]) for k in (1, 2)], "k long, event_id string, tags array<string>")
    assert {r["k"]: r["confirmed"] for r in validation.delivery_confirmed(df, want, "k").collect()} == {1: True, 2: False}


@pytest.mark.parametrize(
    ("reply", "reason"),
    [
        (None, "not an object"), ("[]", "not an object"), ('{"subject": "one", "sounds": []}', "subject empty or too short"), ('{"subject": "two words"}', "sounds is not a list"), ('{"subject": "two words", "sounds": ["x"]}', "a sound is no object"),
        ('{"subject": "two words", "sounds": [{"event_id": "a", "reaction": "loud"}]}', "invalid reaction"), ('{"subject": "two words", "sounds": [{"event_id": " ", "reaction": "pivot"}]}', "empty event_id"), ('{"subject": "two words", "sounds": []}', "no sound typed"),
    ],
)
def test_inferred_faults(spark, reply, reason):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(verdicts.inferred(F.col("r"), F.array(F.lit("a"))).alias("x")).first()["x"]["reason"] == reason


def test_inferred(spark):
    reply = json.dumps({"subject": " a talk ", "sounds": [{"event_id": "a", "reaction": "Pivot "}, {"event_id": "z", "reaction": "verbal"}, {"event_id": "a", "reaction": "ambient"}, {"event_id": "b", "reaction": "behavioral"}]})
    x = spark.createDataFrame([(reply,)], "r string").select(verdicts.inferred(F.col("r"), F.array(F.lit("a"), F.lit("b"))).alias("x")).first()["x"].asDict(True)
    assert x == {"subject": "a talk", "predicted": [{"event_id": "a", "reaction": "pivot"}, {"event_id": "b", "reaction": "behavioral"}], "spurious": ["z"], "reason": None}


def test_judged(spark):
    said = [("dog", "heard", "a dog barked"), ("dog", "nature", "dog barked"), ("bell", "nature", "THE  bell"), ("cat", "discussed", "bell"), ("cow", "heard", "a dog"), ("cat", "unsure", "a dog"), ("cat", "discussed", "a dog")]
    listed = json.dumps([dict(zip(("sound", "verdict", "evidence"), s)) for s in said] + ["text"])
    df = spark.createDataFrame([(listed, "A dog barked. The bell rang."), (None, None)], "v string, s string")
    rows = [r["x"].asDict() for r in df.select(verdicts.judged(F.col("v"), F.array(*map(F.lit, ("dog", "bell", "cat"))), F.col("s")).alias("x")).collect()]
    assert rows[0] == {"heard": ["dog"], "nature": ["bell"], "discussed": ["cat"], "off_list": ["cow"], "no_evidence": ["cat"]}
    assert rows[1] == dict.fromkeys(("heard", "nature", "discussed", "off_list", "no_evidence"), [])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Hello there.", "Hello there."), ("[slightly annoyed] Hello.", "[annoyed] Hello."), ("[a bit] Hello.", "Hello."), ("[loudly] stop that. Now.", "STOP THAT! Now."), ("Wait [shouting, angry] you there! ok", "Wait [angry] YOU THERE! ok"),
        ("So [softer] well", "So well"), ("[laughs] Yes [to the] no", "[laughs] Yes no"), (None, None),
    ],
)
def test_strengthened_tags(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tags.strengthened(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("text", "words", "want"),
    [
        ("I was... going", [(1.0, 1.2, 0), (1.3, 1.5, 2), (3.5, 4.0, 9)], (2.5, "break")), ("I was going", [(1.0, 1.2, 0), (1.3, 1.5, 2), (2.7, 4.0, 6)], (1.7, "pause")),
        ("I was. Going", [(1.0, 1.2, 0), (1.3, 1.5, 2), (3.5, 4.0, 7)], None), ("I was going", [(1.0, 1.2, 0), (1.3, 1.5, 2), (2.6, 4.0, 6)], None), ("It ends...", [(1.0, 1.2, 0), (1.3, 1.5, 3)], None), (None, None, None),
    ],
)
def test_resume_offsets(spark, text, words, want):
    df = spark.createDataFrame([(text, words)], "t string, w array<struct<start:double,end:double,off:long>>")
    got = df.select(timeline.resume_offset(F.col("t"), F.col("w"), F.lit(1.0)).alias("r")).first()["r"]
    assert (got and (round(got["offset"], 6), got["kind"])) == want


def test_rare_sounds(spark):
    df = spark.createDataFrame([(("a/rare_events/x.wav", None, None),), ((None, "rare", False),), ((None, "core", True),), ((None, None, None),)], "e struct<source_file:string,layer:string,is_rare:boolean>")
    assert [r[0] for r in df.select(items.is_rare(F.col("e"))).collect()] == [True, True, True, False]


def test_sequences_are_exact(spark):
    comps = allocation.composition_sequence(spark, 95)
    assert sorted(r["local"] for r in comps.collect()) == list(range(95))
    assert sorted(r["count"] for r in comps.groupBy("composition").count().collect()) == [3] * 25 + [4] * 5
    counts = allocation.composition_sequence(spark, 10, strategy="counts").selectExpr("pivot + verbal + behavioral + ambient AS n").groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in counts} == {0: 3, 1: 3, 2: 2, 3: 2}
    with pytest.raises(ValueError):
        allocation.composition_sequence(spark, 10, {"pivot": 2.0}, "counts")
    with pytest.raises(ValueError):
        allocation.composition_weight({"loud": 2.0})
    assert allocation.parse_boosts(" pivot=2, ambient = 0.5,") == {"pivot": 2.0, "ambient": 0.5} and allocation.parse_boosts(None) == {}
    shares = {r["reaction"]: r["share"] for r in allocation.reaction_targets(allocation.composition_sequence(spark, 30)).collect()}
    assert shares["pivot"] == pytest.approx(0.125, abs=0.1) and sum(shares.values()) == pytest.approx(1.0)


def test_rare_flags_stay_with_pivots(spark):
    rows = allocation.with_rare_flags(allocation.composition_sequence(spark, 90), 90, 0.1).collect()
    assert sum(r["has_rare_event"] for r in rows) == 9 and all(r["pivot"] == 1 for r in rows if r["has_rare_event"])
    few = allocation.with_rare_flags(allocation.composition_sequence(spark, 90), 90, 1.0)
    assert few.where("has_rare_event").count() == few.where("pivot = 1").count()


def test_events_of_a_scenario(spark):
    rows = spark.createDataFrame([(f"s{i}", "x", i % 2 == 0, 1, 1, 0, i % 2) for i in range(40)], "scenario_id string, scene string, has_rare_event boolean, pivot int, verbal int, behavioral int, ambient int")
    pool = spark.createDataFrame([("x", f"e{i}") for i in range(6)], "scene string, event_id string")
    rare = spark.createDataFrame([("x", "rare_events/boom")], "scene string, event_id string")
    found = allocation.scenario_events(allocation.scenario_draws(rows, pool, rare)).collect()
    for i in range(40):
        own = sorted((r for r in found if r["scenario_id"] == f"s{i}"), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(2 + i % 2)) and len({r["event_id"] for r in own}) == len(own)
        assert sorted(r["reaction"] for r in own) == sorted(["pivot", "verbal", *["ambient"] * (i % 2)])
        assert all(r["slot"] != "late" for r in own if r["reaction"] == "pivot")
        assert [r["event_id"] for r in own if r["is_rare"]] == (["rare_events/boom"] if i % 2 == 0 else []) and all(r["reaction"] == "pivot" for r in own if r["is_rare"])


def test_distributions(spark):
    df = spark.read.schema(tables.SCENARIO).json(spark.sparkContext.parallelize([json.dumps(scenario(scene="x", role_a="p", role_b="q", events=[{"event_id": "a", "reaction": "pivot"}, {"event_id": "a", "reaction": "verbal"}]))]))
    got = {(r["kind"], r["value"]): r["n"] for r in records.distributions(records.normalised(df)).collect()}
    assert got == {("composition", "P1V1B0A0"): 1, ("n_events", "2"): 1, ("scene", "x"): 1, ("relation", "p / q"): 1, ("flag", "pivot"): 1, ("reaction", "pivot"): 1, ("reaction", "verbal"): 1, ("event", "a"): 2}


def test_reading_and_writing(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([scenario(), scenario(scene="later"), scenario(scenario_id="s2")]))
    (tmp_path / "map.json").write_text(json.dumps({"s1": scenario(), "s9": scenario(scenario_id="s9")}))
    (tmp_path / "bad.json").write_text('"text"')
    read = lambda name: tables.records(spark, f"{tmp_path}/{name}.json", tables.SCENARIO, "scenario_id")
    assert {(r["scenario_id"], r["scene"]) for r in read("list").collect()} == {("s1", "later"), ("s2", None)}
    assert {r["scenario_id"] for r in read("map").collect()} == {"s1", "s9"}
    with pytest.raises(Exception):
        read("bad").collect()
    tables.write_records(read("map"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    assert records.restricted(read("map"), ()).count() == 2 and records.restricted(read("map"), ("dev",)).count() == 0


def test_files(spark, tmp_path):
    for name in ("dog/a.wav", "dog/b.MP3", "dog/.c.wav", "dog/d.txt", "cat/e.flac"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "one.manifest.json").write_text('{"scenario_id": "m1", "events_placed": []}')
    (tmp_path / "two.manifest.json").write_text('{"scenario_id": "m2"}')
    assert {(r["pool"], r["name"]) for r in tables.audio_files(spark, str(tmp_path)).collect()} == {("dog", "a.wav"), ("dog", "b.MP3"), ("cat", "e.flac")}
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("scenario_id", T.StringType()), T.StructField("events_placed", T.ArrayType(T.StringType()))])
    (found,) = tables.manifests(spark, str(tmp_path), schema).collect()
    assert found["scenario_id"] == "m1" and found["manifest_path"].endswith("one.manifest.json")
    kinds = spark.createDataFrame([("s", "s.mp3", "mp3"), ("s", "s.wav", "wav"), ("t", "t.ogg", "ogg")], "id string, name string, extension string")
    assert {r["id"]: r["name"] for r in tables.first_by_priority(kinds, "id", ["wav", "mp3"]).collect()} == {"s": "s.wav", "t": "t.ogg"}


def test_streams_once_and_resume(spark, tmp_path):
    source = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:02")], "k long, ts string").selectExpr("k", "cast(ts AS timestamp) AS ts")
    source.write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    unique = stream_events.once(read(), ["k"], "1 hour")
    assert stream_events.run_to_end(unique.groupBy("k").count(), "complete", ["k"]).count() == 2
    for more in (3, 3, 4):
        stream_events.resume(read(), f"{tmp_path}/state", f"{tmp_path}/out", lambda df: df.select("k"))
        assert spark.read.parquet(f"{tmp_path}/out").count() == more
        if more == 3 and not (tmp_path / "added").exists():
            (tmp_path / "added").mkdir()
        elif more == 3:
            spark.createDataFrame([(5,)], "k long").selectExpr("k", "cast('2024-01-02' AS timestamp) AS ts").write.mode("append").parquet(f"{tmp_path}/in")


@pytest.mark.parametrize(("changes", "want"), [({}, None), ({"n": 2}, "wrong count"), ({0: (" ", "a b c d")}, "empty title"), ({1: ("B", None)}, "empty description"), ({1: ("B", "a b c")}, "description too short"), ({2: (" a.", "a b c d")}, "duplicate title")])
def test_template_faults(spark, changes, want):
    rows = [("k", i, *changes.get(i, (title, "a b c d"))) for i, title in enumerate(["A", "B", "C"])]
    df = spark.createDataFrame(rows, "k string, i int, title string, description string")
    assert validation.template_faults(df, "k", "i", changes.get("n", 3)).first()["reason"] == want


def test_sizes():
    assert quota.parse_sizes("80%/10%/10%", 1000) == {"train": 800, "dev": 100, "test": 100} and quota.parse_sizes("8/1/1", 10)["train"] == 8
    assert quota.parse_sizes("none", 5) is None and quota.parse_sizes("", 5) is None
    for wrong in ("5/5", "5/5/5", "12/-1/-1"):
        with pytest.raises(ValueError):
            quota.parse_sizes(wrong, 10)
