import math
import re

import numpy as np
from parlance.llm import language_id as L
from pyspark.sql import functions as F


def test_document_frequencies(spark):
    texts = ["the cat", "The dog", "", None, "le chat le chat"]
    df, n = L.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = np.zeros(L.BUCKETS)
    for t in texts:
        own = {g for w in L.words_of(t) for g in L.grams().apart([w])[0].tolist()}
        want[list(own)] += 1
    assert n == 5 and (df == want).all()


def test_temperature_is_found():
    random = np.random.default_rng(0)
    p = random.dirichlet([1, 1, 1], 4000)
    y = np.array([random.choice(3, p=q) for q in p])
    assert abs(L.temperature(3.0 * np.log(p), y) - 3.0) < 0.3


def test_l1_leaves_zeros():
    rows = [(np.array([0, 2 + i % 50]), np.array([1.0, 0.001])) if i % 2 else (np.array([1, 2 + i % 50]), np.array([1.0, 0.001])) for i in range(400)]
    w, _ = L.ftrl(rows, np.array([i % 2 for i in range(400)]), 2)
    assert w[0, 1] > 0.5 and w[1, 0] > 0.5 and not w[2:].any()


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = L.train(docs, per_class=200)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 ... 34"), (-4, "the " * 30000), (None, "der und die")], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r for r in L.identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (-1, -2, -3, -4, None)] == ["und"] * 3 + ["en", "de"] and got[-1]["score"] == 0
    held = L.identify(docs.where(L.remainder("doc_id", 4) == 2), model)
    right, n, p = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.avg("score")).first()
    assert n > 2000 and right > 0.97 and abs(p - right) < 0.05


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    rows = L.identify(docs, L.train(docs)).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)]
    assert L.identify(docs.where("doc_id = 2"), L.train(docs.where("doc_id = 2"))).count() == 0


def test_scores_against_brute_force(spark):
    """TF-IDF logits summed feature by feature, and the softmax of the temperature."""
    random = np.random.default_rng(8)
    model = L.Model(["de", "en", "fr"], random.standard_normal((L.BUCKETS, 3)), random.standard_normal(3), 1.7)
    texts = ["the river ran by the mill", "Der Fluss, der Fluss!", "x", "12 a1b"]
    found = L.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for text, row in zip(texts, found):
        ids = [int(i) for w in re.sub(r"[^a-z]", " ", text.lower()).split() for i in L.grams().apart([w])[0]]
        logits = (sum(model.weights[i] for i in ids) / max(1, len(ids)) + model.bias) / 1.7
        p = np.exp(logits) / np.exp(logits).sum()
        assert row["lang_pred"] == model.languages[int(p.argmax())] and abs(row["score"] - p.max()) < 1e-9


def test_ftrl_against_plain_steps():
    """Weights after two passes, each coordinate's update written out on its own."""
    rows = [(np.array([0, 3]), np.array([1.0, 0.5])), (np.array([3]), np.array([2.0])), (np.array([1]), np.array([1.5]))]
    y = np.array([0, 1, 1])
    w, bias = L.ftrl(rows, y, 2, epochs=2)
    z, n = {}, {}

    def weight(i, c):
        zi = z.get((i, c), 0.0)
        return 0.0 if abs(zi) <= 0.02 else -(zi - math.copysign(0.02, zi)) / ((1 + math.sqrt(n.get((i, c), 0.0))) / 0.5 + 0.02)

    for e in range(2):
        for d in np.random.default_rng([3, e]).permutation(3):
            own = [*zip(rows[d][0].tolist(), rows[d][1].tolist()), (-1, 1.0)]
            logits = [sum(x * weight(i, c) for i, x in own) for c in (0, 1)]
            p = [math.exp(a) / sum(map(math.exp, logits)) for a in logits]
            steps = [(i, c, x * (p[c] - (y[d] == c)), weight(i, c)) for i, x in own for c in (0, 1)]
            for i, c, g, now in steps:
                before = n.get((i, c), 0.0)
                n[i, c] = before + g * g
                z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(n[i, c]) - math.sqrt(before)) / 0.5 * now
    assert all(abs(w[i, c] - weight(i, c)) < 1e-9 for i in range(5) for c in (0, 1)) and all(abs(bias[c] - weight(-1, c)) < 1e-9 for c in (0, 1))


def test_repeated_rows_teach_once(spark):
    rows = [(i, ("the cat sat" if i % 2 else "der hund lief") + f" {i}", "en" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hot = docs.unionByName(spark.range(100_000).selectExpr("7L AS doc_id", "'the cat sat 7' AS text", "'en' AS lang"))
    found = L.identify(docs, L.train(hot, per_class=60_000))
    assert found.where("lang_pred = lang").count() == 200
