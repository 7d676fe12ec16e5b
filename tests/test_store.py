"""The keyed store, and attempts as a stream."""

import shutil

from pyspark.sql import functions as F

from parlance.operators import filtering
from parlance.sources.store import KeyedStore
from parlance.streaming.attempts import attempt_states
from parlance.streaming.events import run_to_end

SCHEMA = "k string, v long, note string"


def state(store):
    return {r["k"]: (r["v"], r["note"]) for r in store.rows().collect()}


def test_last_write_wins_and_compaction(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", "k", SCHEMA, 4)
    assert state(store) == {} and store.versions() == []
    rows = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    store.record(rows(("a", 1, "x"), ("b", 2, None), (None, 3, "lost"), ("c", 4, "x"), ("c", 5, "w")))
    store.record(rows(("a", 7, "later")).select("k", "v"))
    assert state(store) == {"a": (7, None), "b": (2, None), "c": (5, "w")}
    assert store.drop(F.col("v") > 4) == 1 and store.drop(F.lit(True)) == 0
    assert state(store) == {"a": (7, None), "c": (5, "w")}
    assert {r["k"] for r in store.rows(only=["a", "b"]).collect()} == {"a"}
    store.record(rows(("b", 9, "back")))
    number = store.compact()
    assert store.versions() == [(number, "whole")] and state(store) == {"a": (7, None), "b": (9, "back"), "c": (5, "w")}
    items = spark.createDataFrame([("a", 1), ("z", 2), (None, 3), ("b", 4)], "k string, n int")
    assert {r["n"] for r in store.pending(items).collect()} == {2, 3}
    assert {r["n"] for r in store.pending(items, F.col("note") == "back").collect()} == {1, 2, 3}


def test_a_killed_write_leaves_the_state(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", "k", SCHEMA, 4)
    store.record(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    number = store.record(spark.createDataFrame([("a", 2, "y"), ("b", 2, "y")], SCHEMA))
    (tmp_path / "s" / f"{number:012d}-rows" / "_SUCCESS").unlink()  # as if it had been killed before its commit
    assert state(store) == {"a": (1, "x")}
    after = store.record(spark.createDataFrame([("c", 3, "z")], SCHEMA))
    assert after == number + 1 and state(store) == {"a": (1, "x"), "c": (3, "z")}
    again = KeyedStore(spark, f"{tmp_path}/s", "k", SCHEMA, 4)
    again.compact()
    assert state(again) == {"a": (1, "x"), "c": (3, "z")} and len(list((tmp_path / "s").iterdir())) == 1
    shutil.rmtree(tmp_path / "s")
    assert state(again) == {}


def test_stream_and_batch_agree_after_a_restart(spark, tmp_path):
    schema = "id long, pass int, accepted boolean"
    first = [(i, p, (i + p) % 5 == 0) for i in range(30) for p in range(i % 3)]
    second = [(i, p, None if i == 4 else (i + p) % 7 == 0) for i in range(30) for p in range(i % 3, i % 3 + i % 2 + 1)]
    read = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for n, rows in enumerate((first, second)):
        spark.createDataFrame([*rows, (None, n, True)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = run_to_end(attempt_states(read(), "id", "accepted", 3), "update", ["id"], f"{tmp_path}/run")
        attempts = spark.read.parquet(f"{tmp_path}/in").where("id IS NOT NULL")
        steps = filtering.next_steps(attempts.select("id").distinct(), attempts.where("accepted").select("id").distinct(), attempts, "id", 3)
        assert {tuple(r) for r in found.select("id", "n_attempts", "state").collect()} == {tuple(r) for r in steps.select("id", "n_attempts", "state").collect()}
