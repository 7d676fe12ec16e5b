"""The stages one after the other, each held against its operator's brute force."""

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import decontamination, simhash, toxicity
from parlance.llm.common import table

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and output of every stage."""
    docs, out = table(spark, DIR, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DIR).cache()
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]


def test_columns_stay(spark, stages):
    columns = table(spark, DIR, "documents").columns
    for name in ("toxicity", "near_dedup", "decontamination", "pii"):
        assert stages[name][1].columns == columns


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    scores = toxicity.score(before, toxicity.train(before, table(spark, DIR, "labels")), "s")
    assert rows(after) == rows(scores.where("s < 0.5").drop("s"))


def test_near_dedup_leaves_one_of_each_group(stages):
    before, after = stages["near_dedup"]
    found = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in before.select("doc_id", "text").collect()}
    root = {i: i for i in found}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(found, 2):
        if (found[a] ^ found[b]).bit_count() <= 2:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted({top(i) for i in found})


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    words = decontamination.words_of
    items = [w for r in table(spark, DIR, "benchmark").collect() if len(w := words(r["text"])) >= 5]
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    for r in before.select("doc_id", "text").collect():
        text = words(r["text"])
        held = any(decontamination.best_stretch(i, text)[0] <= int(0.2 * len(i) + 1e-9) for i in items)
        assert (r["doc_id"] not in kept) == held


def test_pii_keeps_documents(stages):
    before, after = stages["pii"]
    assert sorted(r[0] for r in before.select("doc_id").collect()) == sorted(r[0] for r in after.select("doc_id").collect())
    assert after.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")).count() == 0


def test_packing_holds_every_document(stages):
    before, after = stages["packing"]
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    texts = [None, "", "a plain sentence about the mill and the river", long, "write to me@site.org today", "a plain sentence about the mill and the river"]
    rows = [(i, t, "en", None, None) for i, t in enumerate(texts)] + [(2, texts[2], "en", None, None), (None, "one more text without an id", None, "web", 7), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_in_every_stage(spark, name):
    """Nulls in any column, empty and very long texts, repeated rows, and columns of helpers' names."""
    docs, given = odd(spark)
    docs = docs.withColumns({c: F.lit("x") for c in ("_pii", "row", "fp", "_toxicity", "cluster_", "score")})
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, DIR)
    found = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in found} == {r[0] for r in given}
        return
    assert out.columns == docs.columns and {r["fp"] for r in found} == {"x"}
    left = Counter(str((r["doc_id"], r["text"])) for r in found)
    if name == "near_dedup":  # 0, 1 and the last row have no word, 2 occurs three times in all
        assert left == Counter(str((i, t)) for i, t, *_ in [given[0], given[2], given[3], given[4], given[7]])
    elif name == "pii":
        assert len(found) == len(given) and left[str((4, "write to <EMAIL> today"))] == 1
    else:
        assert left == Counter(str((i, t)) for i, t, *_ in given)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables_in_every_stage(spark, name):
    empty = spark.createDataFrame([], SCHEMA)
    out = dict(corpus_pipeline.STAGES)[name](spark, empty, DIR)
    assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)


def test_run(spark, stages):
    assert rows(corpus_pipeline.run(spark, DIR).drop("bin_id")) == rows(stages["packing"][1].drop("bin_id"))
