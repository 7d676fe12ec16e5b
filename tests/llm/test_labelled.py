"""Quality and toxicity: held-out figures, sentences that offend, odd rows."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance.llm import quality, toxicity
from parlance.llm.common import Subwords, labelled_sample, remainder
from parlance.llm.queries import op1_subword_quality, op10_mil_toxicity

DIR = "/root/testdata/sf0.01"
BAD, CLEAN = "you stupid wretched fool", "the river ran slowly past the mill"


def held_out(spark, found, label):
    labels = spark.read.parquet(f"{DIR}/labels.parquet").groupBy("doc_id").agg(F.max(label).alias("y"))
    return found.where("held_out").join(labels, "doc_id").toPandas()


def auc(score, y) -> float:
    rank = score.rank().to_numpy()
    ones = (y == 1).to_numpy()
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_quality_held_out(spark):
    rows = held_out(spark, op1_subword_quality(spark, DIR), "quality")
    assert auc(rows["score"], rows["y"]) > 0.97
    assert (rows["predicted"] == rows["y"]).mean() > 0.95


def test_toxicity_held_out(spark):
    rows = held_out(spark, op10_mil_toxicity(spark, DIR), "toxic")
    assert (rows["predicted"] == rows["y"]).mean() > 0.9


@pytest.mark.parametrize(("query", "threshold"), [(op1_subword_quality, 0.3), (op10_mil_toxicity, 0.5)])
def test_contract(spark, query, threshold):
    found = query(spark, DIR)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = found.toPandas()
    assert len(rows) == spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= threshold)).all()


def corpus(spark):
    texts = [(i, " ".join([CLEAN + "."] * (i % 4)) + (f" {BAD}." if i % 3 == 0 else " it is late.")) for i in range(150)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))


def test_offending_sentences_are_located(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    found = toxicity.locate(docs, model).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {texts[r.doc_id][r.start : r.end].strip() for r in found.itertuples()} == {BAD}
    assert set(found["doc_id"]) == {i for i in texts if i % 3 == 0}


def test_noisy_or_is_of_the_sentences(spark):
    docs, labels = corpus(spark)
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    text = f"{CLEAN}. {BAD}! {CLEAN}\n{BAD}"
    p = toxicity.sigmoid(scorer.logits([words for _, _, words in toxicity.sentences(text)]))
    assert scorer.documents(pd.Series([text]))[0] == pytest.approx(1 - np.prod(1 - p), abs=1e-9)


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_rows(spark, operator):
    label = "quality" if operator is quality else "toxic"
    docs, labels = corpus(spark)
    model = operator.train(docs, labels.withColumnRenamed("toxic", label))
    odd = [(1, None, "x"), (1, "", "x"), (1, "", "x"), (None, "\t \n", "x"), (2, BAD * 3000, None), (3, "...!?", "x")]
    rows = operator.score(spark.createDataFrame(odd, "doc_id long, text string, Score string"), model)
    assert rows.columns == ["doc_id", "text", "score"]
    scores = [r["score"] for r in rows.collect()]
    assert len(scores) == len(odd) and all(0 <= s <= 1 for s in scores)
    assert scores[0] == scores[1] == scores[2] == scores[3]
    assert operator.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_labels_of_one_class_or_none(spark, operator):
    label = "quality" if operator is quality else "toxic"
    docs, labels = corpus(spark)
    one = operator.score(docs, operator.train(docs, labels.select("doc_id", F.lit(1).alias(label)))).agg(F.min("score"), F.max("score")).first()
    assert one[0] > 0.99 and one[0] == pytest.approx(one[1])
    none = operator.train(docs, labels.select("doc_id", F.lit(None).cast("int").alias(label)))
    assert operator.score(docs, none).first()["score"] == pytest.approx(0.5)


def test_held_out_labels_are_never_learned_from(spark):
    docs, labels = corpus(spark)
    changed = labels.withColumn("toxic", F.when(remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, changed)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def plain_words(model, words, low, high, buckets):
    """Sum of a model's weights over the features of words, and how many there are, one word at a time."""
    total, n = 0.0, 0
    for w in words:
        for ids in Subwords(low, high, buckets).apart([w]):
            total += float(model[ids].sum(dtype=np.float64))
            n += len(ids)
    return total, n


@pytest.fixture(scope="module")
def some_texts(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id % 40 = 0").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in rows] + [(-1, None), (-2, ""), (-3, "a a a b")]


def test_quality_scores_against_brute_force(spark, some_texts):
    random = np.random.default_rng(5)
    model = quality.Model((random.standard_normal(quality.BUCKETS) * 3).astype(np.float32), -0.3)
    found = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(some_texts, "doc_id long, text string"), model).collect()}
    for i, text in some_texts:
        total, n = plain_words(model.features, quality.tokens(text), quality.LOW, quality.HIGH, quality.BUCKETS)
        assert abs(found[i] - 1 / (1 + math.exp(0.3 - total / max(n, 1)))) < 1e-6


def test_quality_training_against_plain_steps():
    """One pass over three small bags, each step written out anew."""
    bags = [(np.array([1, 5]), np.array([2, 1])), (np.array([5]), np.array([4])), (np.array([2, 1]), np.array([1, 1]))]
    y, weight = np.array([1, 0, 1]), np.array([0.5, 1.0, 2.0])
    model = quality.fit(bags, y, weight, epochs=1)
    random = np.random.default_rng(7)
    v = random.uniform(-1 / quality.WIDTH, 1 / quality.WIDTH, (quality.BUCKETS, quality.WIDTH)).astype(np.float32)
    layer, bias = np.zeros((quality.WIDTH, 2)), np.zeros(2)
    for step, d in enumerate(random.permutation(3)):
        ids, often = bags[d]
        share = often / often.sum()
        hidden = sum(s * v[i].astype(float) for s, i in zip(share, ids))
        e = np.exp(hidden @ layer + bias)
        g = (e / e.sum() - np.eye(2)[y[d]]) * weight[d] * 5.0 * (1 - step / 3)
        back = layer @ g
        layer, bias = layer - np.outer(hidden, g), bias - 0.1 * g
        for s, i in zip(share, ids):
            v[i] -= s * len(ids) * 0.05 * back
    assert np.allclose(model.features, v @ (layer[:, 1] - layer[:, 0]), atol=1e-5) and abs(model.bias - (bias[1] - bias[0])) < 1e-5


def test_toxicity_scores_against_brute_force(spark, some_texts):
    random = np.random.default_rng(6)
    model = toxicity.Model((random.standard_normal(toxicity.BUCKETS) * 0.05).astype(np.float32), -2.0)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(some_texts, "doc_id long, text string"), model).collect()}
    for i, text in some_texts:
        none = 1.0
        for sentence in re.split(r"[.!?\n\r]", text or ""):
            words = set(re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", sentence.lower()).split())
            if words:
                none /= 1 + math.exp(-2.0 + plain_words(model.weights, words, toxicity.LOW, toxicity.HIGH, toxicity.BUCKETS)[0])
        if none == 1.0:  # no sentence: a bag with one empty sentence
            none /= 1 + math.exp(-2.0)
        assert abs(found[i] - (1 - none)) < 1e-6


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_a_sample_holds_one_row_of_an_id(spark, label):
    docs = spark.range(100_000).selectExpr("if(id < 99000, 7, id) AS doc_id", "concat('text ', id) AS text")
    docs = docs.unionByName(spark.createDataFrame([(99_500, "x" * 60)], "doc_id long, text string"))
    labels = docs.selectExpr("doc_id", f"cast(doc_id % 2 AS int) AS {label}")
    sample, totals = labelled_sample(docs, labels, label, 40, longest=50)
    rows = sample.collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) <= 80 and sum(totals.values()) == docs.select("doc_id").distinct().where("crc32(cast(doc_id AS string)) % 5 <> 0").count()
    assert all(len(r["text"]) <= 50 for r in rows)


def test_a_sample_is_bounded_in_characters(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    whole, _ = labelled_sample(docs, labels, "quality", 100)
    some, totals = labelled_sample(docs, labels, "quality", 100, characters=1050)
    assert some.count() == 10 < whole.count() and sum(totals.values()) == whole.count()


def test_sentences_of_rows_without_an_id(spark):
    model = toxicity.train(*corpus(spark))
    odd = spark.createDataFrame([(None, f"{CLEAN}. {BAD}."), (5, f"{BAD}."), (6, None)], "doc_id long, text string")
    found = toxicity.locate(odd, model).collect()
    assert {r["doc_id"] for r in found} == {None, 5}
