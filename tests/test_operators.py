"""Edge cases on literal frames."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import levels, signal, text
from parlance.functions.loose_json import read_reply
from parlance.operators import cache, filtering, metrics, quota, timeline

RATIOS = {"train": 0.9, "dev": 0.05, "test": 0.05}


@pytest.mark.parametrize("ratios", [RATIOS, {"train": 1.0}, {"train": 0.5, "test": 0.5}, {"train": 0.34, "dev": 0.33, "test": 0.33}])
def test_split_counts_hold_what_they_promise(spark, ratios):
    """All files are dealt, each split is near its exact share, and every split with a ratio has one where there are enough."""
    found = spark.range(60).select("id", quota.split_counts(F.col("id"), ratios, each_one=True).alias("c")).collect()
    wanted = [i for i, s in enumerate(quota.SPLITS) if ratios.get(s, 0.0) > 0]
    for n, counts in ((r["id"], r["c"]) for r in found):
        assert sum(counts) == n and all(c == 0 for i, c in enumerate(counts) if i not in wanted)
        assert sum(counts[i] > 0 for i in wanted) == min(n, len(wanted))
        if n >= 60 // 2:
            assert all(abs(c - n * ratios.get(s, 0.0)) < 2 for s, c in zip(quota.SPLITS, counts))


@pytest.mark.parametrize(("n", "counts"), [(0, [0, 0, 0]), (1, [1, 0, 0]), (2, [1, 1, 0]), (3, [1, 1, 1]), (10, [8, 1, 1]), (20, [18, 1, 1]), (50, [45, 3, 2]), (100, [90, 5, 5])])
def test_split_counts_of_some_pools(spark, n, counts):
    assert spark.range(1).select(quota.split_counts(F.lit(n), RATIOS, each_one=True)).first()[0] == counts


def test_largest_remainder_with_zero_weights(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "p string, w long").withColumn("t", F.lit(10))
    assert {r["p"]: r["quota"] for r in quota.largest_remainder(df, "t", "w", "p").collect()} == {"a": 4, "b": 3, "c": 3}


@pytest.mark.parametrize(("correct", "reverse"), [(0, 0), (5, 5), (9, 0), (0, 3), (400, 300), (700, 650)])
def test_mcnemar(spark, correct, reverse):
    n, k = correct + reverse, max(correct, reverse)
    exact = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n)
    p = spark.range(1).select(metrics.mcnemar_p(F.lit(correct), F.lit(reverse))).first()[0]
    assert p == pytest.approx(exact, abs=1e-9)


def test_kappa_without_a_valid_pair_is_null(spark):
    counts = spark.createDataFrame([("0", "x", 3)], "gold string, pred string, n long")
    assert [r["kappa"] for r in metrics.kappa(counts, ["0", "1"]).collect()] in ([], [None])


def test_kappa_with_certain_agreement_is_null(spark):
    counts = spark.createDataFrame([("0", "0", 3)], "gold string, pred string, n long")
    assert metrics.kappa(counts, ["0", "1"]).first()["kappa"] is None


def test_slots_at_the_edge(spark):
    rows = spark.createDataFrame([(13, 30, "early"), (14, 30, "early"), (1, 2, "late"), (30, 30, "late"), (10, 30, None)], "seen long, total long, slot string")
    assert [r[0] for r in rows.select(timeline.slot_ok(F.col("seen"), F.col("total"), F.col("slot"))).collect()] == [True, False, True, True, True]


def test_events_before_any_utterance(spark):
    rows = spark.createDataFrame([(1, 0, "e"), (1, 1, "u"), (1, 2, "e"), (1, 3, "u"), (1, 4, "e")], "k long, o long, kind string")
    found = timeline.utterances_before(rows, "k", "o", F.col("kind") == "u").orderBy("o").collect()
    assert [r["after_turn"] for r in found if r["kind"] == "e"] == [None, 0, 1]


@pytest.mark.parametrize("sizes", [[5, 3], [1, 9, 1, 1], [20], [3, 3, 3, 1], [4, 6, 10, 1]])
def test_pack_in_order(spark, sizes):
    chunks, now = [], []
    for i, s in enumerate(sizes):
        if now and sum(sizes[j] for j in now) + s > 10:
            chunks.append(now)
            now = []
        now.append(i)
    chunks.append(now)
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "k long, o long, s long")
    found = timeline.pack_in_order(df, "k", "o", F.col("s"), 10).orderBy("chunk").collect()
    assert [(r["first"], r["last"]) for r in found] == [(c[0], c[-1]) for c in chunks]


def test_regenerate_until_the_limit(spark):
    scenarios = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    attempts = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2, "id string")
    found = filtering.next_steps(scenarios, scenarios.where("id = 'c'"), attempts, "id", 3).collect()
    assert {r["id"]: (r["n_attempts"], r["state"]) for r in found} == {"a": (3, "abandoned"), "b": (2, "regenerate"), "c": (0, "accepted")}


def test_accepted_at_tau_and_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    cos = filtering.cosine(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(cos, filtering.accepted(cos, F.lit(True), 1.0)).collect()] == [(1.0, True), (None, False), (None, False)]


def test_cache_prefers_answers_then_earlier_sources(spark):
    a = spark.createDataFrame([("x", "old", False), ("y", "bad", True), ("z", "bad", True)], "k string, v string, e boolean")
    b = spark.createDataFrame([("x", "new", False), ("y", "good", False), ("z", "worse", True)], "k string, v string, e boolean")
    assert {r["k"]: r["v"] for r in cache.merge([a, b], "k", "e").collect()} == {"x": "old", "y": "good", "z": "bad"}


@pytest.mark.parametrize(("reply", "answer"), [("Red", "red"), (" BLUE ", "blue"), ("it is red", "red"), ("red or blue", None), ("", None), (None, None)])
def test_read_choice(spark, reply, answer):
    df = spark.createDataFrame([(reply,)], "r string").withColumn("o", F.array(F.lit("red"), F.lit("blue")))
    assert df.select(text.read_choice(F.col("r"), F.col("o"))).first()[0] == answer


def test_evidence_needs_two_words(spark):
    df = spark.createDataFrame([("Bell", "the bell rang"), ("the  “bell”", 'the "Bell" rang'), ("a cat", "the bell")], "e string, t string")
    assert [r[0] for r in df.select(text.evidence_in(F.col("e"), F.col("t"))).collect()] == [False, True, False]


@pytest.mark.parametrize(
    ("raw", "status"),
    [("{'a': 1} tail", "ok_literal"), ('<think>{"a": 1}</think> nothing', "no_json"), ("null", "no_json"), ("{'a': ['b", "ok_literal"), ("```\n{'a': 1}\n```", "ok_literal"), ('{"a": 1}', "ok"), ('Sure: {"a": "}"} done', "ok"), ("```json\n[1, 2]\n```", "ok"), ("{'a': True}", "ok_literal"), ("", "empty_response"), (None, "empty_response"), ("nothing here", "no_json")],
)
def test_loose_json(spark, raw, status):
    assert spark.createDataFrame([(raw,)], "r string").select(read_reply(F.col("r")).alias("x")).first()["x"]["status"] == status


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "k long, o long, kind string, s long")
    assert timeline.pack_in_order(empty, "k", "o", F.col("s"), 10).count() == 0
    assert timeline.runs(empty, "k", ["o"], "kind").count() == 0
    assert timeline.first_failure(empty, "k", "o", [("bad", F.col("kind").isNull())]).count() == 0


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("layer", "metres", "level"), [("core", 2.0, -20.0), ("supporting", 2.0, -23.0), ("rare", 2.0, -17.0), ("other", 2.0, -20.0), ("core", 4.0, -26.0206), ("core", 100.0, -29.0), ("core", 0.0, -16.0), ("core", None, -20.0)])
def test_event_level(spark, layer, metres, level):
    assert one(spark, levels.event_level(F.lit(layer), F.lit(metres).cast("double"))) == pytest.approx(level, abs=1e-4)


@pytest.mark.parametrize(("metres", "hertz"), [(2.0, None), (4.0, 11875.576), (1000.0, 3500.0)])
def test_lowpass(spark, metres, hertz):
    assert one(spark, levels.lowpass_hz(F.lit(metres))) == (None if hertz is None else pytest.approx(hertz, abs=1e-2))


@pytest.mark.parametrize(("asked", "event", "applied"), [(-9.0, None, -9.0), (3.0, -30.0, 0.0), (-9.0, -14.0, 0.0), (-9.0, -17.0, -3.0), (-9.0, -40.0, -9.0), (-9.0, -10.0, 0.0)])
def test_duck(spark, asked, event, applied):
    assert one(spark, levels.duck(F.lit(asked), F.lit(event).cast("double"))) == applied


@pytest.mark.parametrize(("margin", "bucket"), [(0.0, "0-6 dB"), (5.994, "0-6 dB"), (5.996, "6-10 dB"), (10.0, "10-15 dB"), (15.0, "15-inf dB"), (-0.1, "unknown"), (None, "unknown")])
def test_margin_bucket(spark, margin, bucket):
    assert one(spark, levels.margin_bucket(F.lit(margin).cast("double"))) == bucket


@pytest.mark.parametrize(("base", "metres", "wet"), [(0.0, 5.0, 0.0), (1.0, 5.0, 0.25), (0.1, 2.0, 0.1), (0.1, 4.0, 0.25), (0.02, 4.0, 0.075472)])
def test_wet_mix(spark, base, metres, wet):
    assert one(spark, levels.wet_mix(F.lit(base), F.lit(metres))) == pytest.approx(wet, abs=1e-6)


def test_distance_ranges(spark):
    profiles = spark.createDataFrame([("beach/gull", 5.0, 60.0), ("rare_events/thunder", 300.0, 3000.0)], "event_id string, near double, far double")
    events = [("beach/gull", "beach"), ("rural/gull", "office"), ("rare_events/thunder", "office"), ("rare_events/other", "office"), ("general/clap", "beach"), ("rural/pump", None), ("general/clap", "office")]
    found = {(r["event_id"], r["scene"]): (r["near"], r["far"]) for r in levels.with_distance_range(spark.createDataFrame(events, "event_id string, scene string"), profiles).collect()}
    assert found == dict(zip(events, [(5.0, 60.0), (5.0, 60.0), (300.0, 3000.0), (5.0, 60.0), (1.5, 20.0), (1.5, 20.0), (1.0, 6.0)]))


def test_forbidden_phrases(spark):
    cases = [("Well; no", "semicolon"), ("Um, yes", "hesitation filler"), ("umbrella", None), ("Are you still there?", "phone call marker"), ("hold on, I'm on another call", "phone call marker"), ("a: hello", "speaker label"), ("[sighs] [laughs]", "tags only"), ("[sighs] so", None), ("Where was I?", "worn phrasing: where was I"), ("where was I born", None), ("*nods* ok", "stage direction"), (None, None)]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [r["found"] for r in df.select(text.first_forbidden(F.col("t")).alias("found")).collect()] == [want for _, want in cases]
    assert len(text.FORBIDDEN) == 20


def test_degeneracy_reasons(spark):
    cases = [("", "empty reply"), (None, "empty reply"), (" \n", "empty reply"), ("abab" * 6, "one or two characters"), ("1 2 3", "no alphabetic word"), ("no " * 9, "one or two characters"), ("yes yes " * 5, "a word repeats"), ("a b c d " * 10, "a run repeats"), ("all is well here", None), ("a b c d " * 8, None)]
    rows = text.degeneracy(spark.createDataFrame(list(enumerate(t for t, _ in cases)), "i int, t string"), "t").orderBy("i").collect()
    assert [r["reason"] for r in rows] == [want if t != "no " * 9 else "a word repeats" for t, want in cases]


def test_safe_ids(spark):
    df = spark.createDataFrame([(0, "a/b"), (1, "a?b"), (2, "a/b"), (3, ""), (4, "x" * 70)], "n int, id string")
    found = [r["safe_id"] for r in text.safe_ids(df, "id", "n").orderBy("n").collect()]
    assert found[0] == found[2] == "a-b" and found[1].startswith("a-b-") and len(found[1]) == 12 and found[3:] == ["id", "x" * 64]


def test_a_cycle_uses_every_register_once(spark):
    rows = quota.register_cycle(spark.range(35).selectExpr("id", "0 AS g"), ["g"], ["id"], 7).collect()
    cycles = [[r["register"] for r in sorted(rows, key=lambda r: r["id"]) if r["cycle"] == c] for c in range(5)]
    assert all(sorted(c) == list(range(7)) for c in cycles) and len(set(map(tuple, cycles))) > 1


def test_sizes_come_out_as_asked(spark):
    df = spark.range(103).selectExpr("id", "concat('t', id % 7 * id % 5) AS theme")
    found = quota.assign_sizes(df, ["theme"], ["id"], {"train": 80, "dev": 13, "test": 10})
    assert {r["split"]: r["count"] for r in found.groupBy("split").count().collect()} == {"train": 80, "dev": 13, "test": 10}
    shares = spark.range(1).select(quota.proportional_shares(F.lit(10).cast("long"), F.expr("array(80L, 10L, 10L)"))).first()[0]
    assert shares == [8, 1, 1]
    assert one(spark, quota.proportional_shares(F.lit(5).cast("long"), F.expr("array(8L, 1L, 1L)"))) == [4, 1, 0]
    assert one(spark, quota.proportional_shares(F.lit(5).cast("long"), F.expr("array(0L, 0L, 0L)"))) == [0, 0, 0]


def test_file_partition_by_crc32(spark):
    names = [f"f{i}.wav" for i in range(40)]
    df = spark.createDataFrame([("p", n) for n in names], "pool string, name string")
    got = {r["name"]: r["split"] for r in quota.partition_files(df, {"train": 0.5, "dev": 0.25, "test": 0.25}).collect()}
    order = sorted(names, key=lambda n: (zlib.crc32(f"p|{n}".encode()), n))
    assert [got[n] for n in order] == ["train"] * 20 + ["dev"] * 10 + ["test"] * 10


def test_round_robin(spark):
    for ids in (range(1000), [5] * 300 + list(range(50)), []):
        df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
        got = sorted((r["id"], r["shard"]) for r in quota.round_robin(df, "id", 4, parts=8).collect())
        assert sorted(s for _, s in got) == sorted(n % 4 for n in range(len(ids)))
        assert len(set(ids)) < len(ids) or [s for _, s in got] == [n % 4 for n in range(len(ids))]


def test_fade_and_release():
    x = np.ones(20)
    assert (signal.fade(x[:16], 8) == 1).all() and (signal.fade(x, 0) == 1).all()
    want = [0.0, 0.25, 0.75, 1.0]  # half a cosine over four samples
    assert np.allclose(signal.fade(x, 4)[:4], want) and np.allclose(signal.fade(x, 4)[-4:], want[::-1])
    assert np.allclose(signal.release(x, 4)[-5:], [1.0, *want[::-1]])


def test_trim_keeps_a_pad():
    x = np.zeros(1000)
    x[500:600] = 0.5
    assert len(signal.trim(x, rate=1000)) == 100 + 2 * 30 + 9  # the envelope's window of ten samples reaches four or five further
    assert len(signal.trim(np.zeros(10), rate=1000)) == 10 and len(signal.trim(np.zeros(0))) == 0


def test_duck_envelope():
    low = 10 ** (-6 / 20)
    assert np.allclose(signal.duck_envelope(10, 8, -6.0, 3), [1, (1 + low) / 2, low, low, low, low, (1 + low) / 2, 1, 1, 1])
    assert (signal.duck_envelope(5, 4, 0.0, 2) == 1).all() and (signal.duck_envelope(5, 0, -6.0, 2) == 1).all()


def test_other_signal_helpers():
    x = np.array([0.0, 0.1, 0.9, 0.9, 0.1, 0.0])
    assert signal.loudest_window(x, 2) == 2 and len(signal.loop_or_cut(x, 20, 2)) == 20 and list(signal.loop_or_cut(x, 3, 2)) == [0.0, 0.1, 0.9]
    assert np.allclose(signal.cut_overlap(np.ones(9), 4, 3), [1, 1, 0.5, 0]) and len(signal.cut_overlap(x, 9, 2)) == 6
    assert signal.limiter_gain(x, 0.0) == 1.0 and signal.limiter_gain(x * 2, 0.0) == pytest.approx(1 / 1.8)


@pytest.mark.parametrize(("value", "presence", "reaction"), [('{"present": true}', True, None), ('{"answer": "Non"}', False, None), ('"yes"', True, None), ("false", False, None), ('{"reaction": " Verbal "}', None, "verbal"), ('"pivot"', None, "pivot"), ('{"x": 1}', None, None), (None, None, None), ('"verbal or pivot"', None, None)])
def test_values_of_replies(spark, value, presence, reaction):
    df = spark.createDataFrame([(value,)], "v string")
    assert tuple(df.select(text.presence_of(F.col("v")), text.reaction_of(F.col("v"))).first()) == (presence, reaction)
