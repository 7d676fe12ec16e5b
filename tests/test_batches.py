"""Batches of one long list against the plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.plans import batches
from parlance.plans.batches import batched


def loop(sizes, most, budget):
    """The batch of each size in turn; None for those over the budget."""
    out, batch, n, total = [], 0, 0, 0
    for size in sizes:
        if size > budget:
            out.append(None)
            continue
        if n and (n >= most or total + size > budget):
            batch, n, total = batch + 1, 0, 0
        out.append(batch)
        n, total = n + 1, total + size
    return out


@pytest.mark.parametrize(("most", "budget", "parts", "high"), [(7, 100, 64, 60), (3, 1000, 1, 60), (50, 30, 8, 31), (1, 10, 4, 12), (1000, 10_000, 5, 60), (4, 5, 7, 3)])
def test_as_the_plain_loop(spark, most, budget, parts, high):
    sizes = np.random.default_rng(most).integers(0, high, 1500).tolist()
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "k long, size long, pos string").repartition(5)
    found = sorted(batched(df, ["k"], "size", most, budget, parts).collect(), key=lambda r: r["k"])
    assert [r["batch"] for r in found] == loop(sizes, most, budget)


def test_odd_lists(spark):
    df = spark.createDataFrame([(1, 5, 1), (2, None, 1), (3, 50, 1), (4, 5, 1), (4, 6, 2)], "k long, size long, tie int")
    assert [r["batch"] for r in batched(df, ["k", "tie"], "size", 2, 10).orderBy("k", "tie").collect()] == [0, 0, None, 1, 2]
    assert batched(df.where("false"), ["k", "tie"], "size", 2, 10).count() == 0
    assert batched(df.where("k = 3"), ["k"], "size", 2, 10).first()["batch"] is None
    with pytest.raises(ValueError):
        batched(df, ["k"], "size", 0, 10)


@pytest.mark.parametrize(("most", "budget", "items"), [(3, 1000, 1), (7, 100, 100), (50, 30, 400)])
def test_segments_of_several_sizes_are_as_the_plain_loop(spark, monkeypatch, most, budget, items):
    monkeypatch.setattr(batches, "SEGMENT_ITEMS", items)
    sizes = np.random.default_rng(most).integers(0, 60, 1500).tolist()
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, size long").repartition(5)
    found = sorted(batched(df, ["k"], "size", most, budget).collect(), key=lambda r: r["k"])
    assert [r["batch"] for r in found] == loop(sizes, most, budget)


def test_small_batches_share_a_segment(spark):
    df = spark.range(20_000).select("id", F.lit(1).cast("long").alias("size"))
    assert batches.placed(df, ["id"], "size", 3, 1000, 4).select("_segment").distinct().count() <= 2
