import inspect
import math
import zlib

import numpy as np
import pandas as pd
from parlance.llm import pseudo_likelihood as P


def small_model(seed=3, words=("a", "b", "c", "d", "e")):
    random = np.random.default_rng(seed)
    counts = np.concatenate([random.integers(1, 50, len(words)), random.integers(0, 3, P.HASHED)])
    model = P.Model({w: i for i, w in enumerate(words)}, P.Tree(counts), P.initial(len(words) + P.HASHED, seed))
    model.params = random.standard_normal(model.params.shape).astype(np.float32)
    return model


def plain_log_probability(model, codes, i):
    """log P of word i, by loops over the parameters: embeddings times places, tanh, then a decision at each node."""
    at, pad = P.rows_of(model.classes), model.classes
    h = [float(x) for x in model.params[at["bias"]][0]]
    for k, p in enumerate((-2, -1, 1, 2)):
        own = codes[i + p] if 0 <= i + p < len(codes) else pad
        for j in range(P.WIDTH):
            h[j] += float(model.params[own][j]) * float(model.params[at["places"]][k][j])
    h = [math.tanh(x) for x in h[:-1]] + [1.0]
    total, tree, code = 0.0, model.tree, codes[i]
    for step in range(tree.starts[code], tree.starts[code] + tree.sizes[code]):
        z = sum(x * float(w) for x, w in zip(h, model.params[at["nodes"]][int(tree.nodes[step])]))
        total += -math.log1p(math.exp(-z if tree.right[step] else z))
    return total


def test_vocabulary_counts_all_words(spark):
    docs = spark.createDataFrame([("b a A",), ("a c\tc",), (None,), ("",)], "text string")
    assert P.vocabulary(docs) == {"a": 0, "c": 1, "b": 2} and P.vocabulary(docs, 2) == {"a": 0, "c": 1}


def test_vocabulary_follows_the_corpus(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 149), i -> concat('w', id * 150 + i))) AS text")
    model = P.train(docs, rounds=1)
    assert len(model.words) == 6000 and model.classes == 6000 + P.HASHED


def test_tree_is_a_huffman_code():
    counts = np.random.default_rng(5).integers(0, 1000, 400)
    tree = P.Tree(counts)
    ways = [tuple(zip(tree.nodes[s : s + n].tolist(), tree.right[s : s + n].tolist())) for s, n in zip(tree.starts, tree.sizes)]
    assert len(set(ways)) == 400 and sum(2.0**-n for n in tree.sizes.tolist()) == 1.0 and {w[0][0] for w in ways} == {398}
    import heapq

    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    least = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        least += both
        heapq.heappush(heap, both)
    assert int((tree.sizes * counts).sum()) == least


def test_probabilities_sum_to_one():
    model = small_model()
    codes = np.arange(model.classes, dtype=np.int32)
    context = np.repeat(np.array([[3], [model.classes], [700], [1]], np.int32), len(codes), axis=1)
    assert abs(np.exp(P.log_probabilities(model, codes, context)).sum() - 1) < 1e-4


def test_scores_against_plain_loops():
    model = small_model()
    model.tail = np.log(np.random.default_rng(1).uniform(0.01, 1, 4 * P.HASHED)).astype(np.float32)
    texts = ["a b zz a", "B", "", None, "c c unheard e d a b c d e zz q\tr s"]
    counts, total = P.Scorer(model).documents(pd.Series(texts), piece=3)
    for text, n, got in zip(texts, counts, total):
        words = (text or "").lower().split()
        hashes = [zlib.crc32(w.encode()) for w in words]
        codes = [model.words.get(w, len(model.words) + h % P.HASHED) for w, h in zip(words, hashes)]
        want = sum(plain_log_probability(model, codes, i) for i in range(len(codes)))
        want += sum(float(model.tail[h % len(model.tail)]) for w, h in zip(words, hashes) if w not in model.words)
        assert n == len(words) and abs(want - got) < 1e-3


def test_gradient_against_differences():
    model = small_model()
    codes = np.random.default_rng(1).integers(0, 40, 60).astype(np.int32)
    sides = P.neighbours_of(codes, model.classes)
    start = model.params.astype(np.float64)
    model.params = start
    trainer = P.Trainer(model, rate=1e-6)
    trainer.step(codes, sides)
    at = P.rows_of(model.classes)

    def loss(params):
        own = P.Model(model.words, model.tree, params)
        return -P.log_probabilities(own, codes, sides).sum()

    way = int(model.tree.starts[codes[0]])
    nodes = [int(model.tree.nodes[way + k]) for k in range(int(model.tree.sizes[codes[0]]))]
    rows = [int(codes[3]), model.classes, at["nodes"].start + nodes[0], at["nodes"].start + nodes[-1], at["places"].start + 1, at["bias"].start]
    for row in rows:
        for column in (0, 7):
            moved = []
            for e in (1e-4, -1e-4):
                params = start.copy()
                params[row, column] += e
                moved.append(loss(params))
            slope = (moved[0] - moved[1]) / 2e-4
            gradient = (start[row, column] - trainer.params[row, column]) / 1e-6  # AdaGrad's first step: g / sqrt(1e-3 + g^2)
            assert abs(gradient - slope / np.sqrt(1e-3 + slope**2)) < 2e-3
    assert (trainer.params[at["nodes"]][:, -1] != start[at["nodes"]][:, -1]).any() and (trainer.params[P.HASHED] == start[P.HASHED]).all()


def test_rows_are_averaged_by_how_often_they_were_met():
    values = [(np.full((2, P.WIDTH), 1.0), [3, 0]), (np.full((2, P.WIDTH), 5.0), [1, 0])]
    rows = pd.DataFrame({"block": 0, "lot": 1, "part": [1, 0], "vector": [np.column_stack([v, m]).astype(np.float32).tobytes() for v, m in values]})
    got = np.frombuffer(P.averaged(rows)["vector"].iloc[0], np.float32).reshape(2, -1)
    assert (got[0, :-1] == 2.0).all() and got[:, -1].tolist() == [4.0, 0.0]


def sentences(n, seed):
    random = np.random.default_rng(seed)
    return [" ".join(f"s{random.integers(5)} v{(k := random.integers(5))} o{k}" for _ in range(60)) for _ in range(n)]


def test_texts_in_order_score_better(spark):
    docs = spark.createDataFrame(list(enumerate(sentences(900, 1))), "doc_id long, text string").repartition(3)
    model = P.train(docs)
    own = sentences(20, 2)
    random = np.random.default_rng(0)
    mixed = [" ".join(random.permutation(t.split())) for t in own]
    rows = [(i, t, "x") for i, t in enumerate([*own, *mixed, None, "", "unheard of", "s1 " * 120_000])]
    found = {r["doc_id"]: r for r in P.score(spark.createDataFrame(rows, "doc_id long, text string, n_words string"), model).collect()}
    print([round(found[i]["mean_log_probability"] - found[i + 20]["mean_log_probability"], 2) for i in range(20)])
    assert all(found[i]["mean_log_probability"] > found[i + 20]["mean_log_probability"] + 0.5 for i in range(20))
    assert [(found[i]["n_words"], found[i]["log_likelihood"], found[i]["mean_log_probability"]) for i in (40, 41)] == [(0, 0.0, None)] * 2
    assert found[42]["n_words"] == 2 and found[43]["n_words"] == 120_000 and np.isfinite(found[43]["log_likelihood"])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.score(docs, P.train(docs)).count() == 0


def test_every_document_is_learned_from(spark):
    for i in (None, 0, 1, 2):
        model = P.train(spark.createDataFrame([(i, "a b c a b c")], "doc_id long, text string"), masked=1.0)
        assert (model.params != P.initial(model.classes)).any()


def test_repeated_rows_score_alike(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (1, "d c b a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = P.score(docs, P.train(docs)).collect()
    assert len(found) == 4 and len({r["log_likelihood"] for r in found if r["text"] == "a b c d"}) == 1


def test_words_beyond_the_vocabulary_share_one_probability(spark):
    """The chances of all single words add up to at most one, and none is above one."""
    words = [f"w{i}" for i in range(5000)]
    docs = spark.createDataFrame([(i, " ".join(words[i::50] + ["w4999"] * 3)) for i in range(50)], "doc_id long, text string")
    model = P.train(docs, size=1000)
    total = P.Scorer(model).documents(pd.Series(words))[1]
    assert len(model.words) == 1000 and 0.7 < np.exp(total).sum() <= 1.0001
    counts = spark.createDataFrame([("a", 7), ("b", 1), ("c", 2)], "word string, n long")
    tail, total = P.tail_of(counts, ("c", 2))
    assert tail.max() <= 0 and len(tail) >= P.HASHED and total.sum() == np.float32(1 + P.UNSEEN * len(tail)) or abs(total.sum() - 1 - P.UNSEEN * len(tail)) < 1e-3


def test_training_predicts_every_word():
    model, codes = small_model(), np.arange(1000, dtype=np.int32) % 5
    trainer = P.Trainer(model, masked=inspect.signature(P.train).parameters["masked"].default)
    trainer.learn(codes, P.neighbours_of(codes, model.classes))
    assert trainer.windows == 1000


def test_runs_of_rows_are_summed():
    random = np.random.default_rng(7)
    rows, first = random.standard_normal((500, P.WIDTH)).astype(np.float32), np.array([0, 1, 5, 100, 499])
    assert np.allclose(P.summed(rows, first), np.add.reduceat(rows.astype(float), first), atol=1e-4)


def test_words_are_looked_up_once(spark):
    """The query's way scores as training and scoring apart do, and what it scores holds no texts any more."""
    rows = [(i, t, "x") for i, t in enumerate([*sentences(30, 4), "s1 v1 o1 unheard Ä İ ퟿", "", None, "s1 v1 o1"])]
    rows += [(None, "s1 v1 o1", "x"), (33, "s1 v1 o1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, Text string, n_words string")
    names = ["doc_id", "n_words", "log_likelihood", "mean_log_probability"]
    found = P.scored(docs)
    apart = P.score(docs, P.train(docs)).drop("text")
    assert found.columns == apart.columns == names and "text" not in found._jdf.queryExecution().analyzed().toString().lower()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, apart.collect())) and found.count() == len(rows)
    assert P.scored(docs.limit(0)).count() == 0


def test_packed_words():
    model = small_model()
    model.tail = np.zeros(4 * P.HASHED, np.float32)
    n, classes, rare = P.coder_of(model).pack("A zz b q")
    buckets = [zlib.crc32(w) % (4 * P.HASHED) for w in (b"zz", b"q")]
    assert n == 4 and np.frombuffer(rare, np.int32).tolist() == buckets
    assert np.frombuffer(classes, np.uint16).tolist() == [0, 5 + buckets[0] % P.HASHED, 1, 5 + buckets[1] % P.HASHED]
    assert P.coder_of(model).pack(None) == P.coder_of(model).pack("") == (0, b"", b"")


def test_a_line_of_texts_trains_as_windows_apart():
    model, random = small_model(), np.random.default_rng(2)
    each = [random.integers(0, 40, n).astype(np.uint16) for n in (1, 300, 2, 500, 1, 1, 700)]
    line, apart = P.Trainer(model), P.Trainer(model)
    line.learn_line(*P.lined(each, model.classes))
    codes, sides = np.concatenate(each), np.concatenate([P.neighbours_of(c, model.classes) for c in each], axis=1)
    apart.learn(codes, sides)
    assert np.allclose(line.params, apart.params, atol=1e-4) and (line.params != model.params).any() and line.windows == apart.windows == len(codes)
    at, met = P.rows_of(model.classes), line.met()
    assert (met == apart.met()).all()
    assert met[at["embeddings"]].tolist() == np.bincount(sides.ravel(), minlength=model.classes + 1).tolist()
    ways = [model.tree.nodes[s : s + n] for s, n in zip(model.tree.starts[codes], model.tree.sizes[codes])]
    assert met[at["nodes"]].tolist() == np.bincount(np.concatenate(ways), minlength=model.classes - 1).tolist()


def test_gradients_of_equal_rows_are_added_up():
    random = np.random.default_rng(9)
    rows = np.concatenate([random.integers(0, 30, 200), np.full(50, 3), np.arange(40, 60)]).astype(np.uint16)
    source, at, weights = random.standard_normal((70, P.WIDTH)).astype(np.float32), random.integers(0, 70, len(rows)), random.standard_normal(len(rows)).astype(np.float32)
    want = np.zeros((100, P.WIDTH))
    np.add.at(want, rows + 7, source[at] * weights[:, None])
    trainer = P.Trainer(small_model())
    found = []
    trainer.moved = lambda where, gradient: found.append((where, gradient))
    trainer.by_row(rows, source, at, weights, 7)
    trainer.by_row(rows, source[at] * weights[:, None], offset=7)
    for where, gradient in found:
        assert len(set(where.tolist())) == len(where) == len(set(rows.tolist())) and np.allclose(gradient, want[where], atol=1e-4)
