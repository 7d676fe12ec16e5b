import math

import numpy as np
import pandas as pd
import pytest
from parlance.llm import prefix_forest

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, asked, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in fine:
        if q in asked:
            near = [(-(a @ b) / math.sqrt((a @ a) * (b @ b)), i) for i, b in fine if i != q and len(b) == len(a)]
            out += [(q, r + 1, i, -c) for r, (c, i) in enumerate(sorted((round(c, 12), i) for c, i in near)[:k])]
    return sorted(out)


def vectors():
    random = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in random.standard_normal(16)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties
    return rows + [(400, None), (401, [0.0] * 16), (402, [None] + [1.0] * 15), (403, [math.nan] * 16), (404, [math.inf] * 16), (None, [1.0] * 16), (405, []), (406, [1.0, 2.0]), (408, [2.0, 1.0])]


def test_all_candidates_give_the_exact_answer(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    asked = {0, 7, 50, 1003, 401, 406}
    found = prefix_forest.nearest(df, df.where(df.vec_id.isin(list(asked))), k=5, share=1.0, shard=100, block=3)
    got = sorted((r[0], r[1], r[2], round(r[3], 12)) for r in found.collect())
    assert [(q, r, i) for q, r, i, _ in got] == [(q, r, i) for q, r, i, _ in brute(rows, asked, 5)]
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, brute(rows, asked, 5)))


@pytest.mark.parametrize("rows", [500, 60_000])
def test_recall_as_registered(spark, rows):
    """The query's own settings, on vectors without any structure; 60,000 of them make eight forests."""
    x = np.random.default_rng(rows).standard_normal((rows, 64)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(rows), "embedding": list(x)}))
    asked = np.arange(0, rows, 50 if rows < 1000 else 500)
    found = prefix_forest.nearest(df, df.where(df.vec_id.isin(asked.tolist()))).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = unit[asked] @ unit.T
    cosine[np.arange(len(asked)), asked] = -2
    best = np.argsort(-cosine, axis=1)[:, :5]
    want = {(int(q), int(i)) for q, own in zip(asked, best) for i in own}
    recall = len(want & set(zip(found["query_id"], found["vec_id"]))) / len(want)
    print(f"recall of {rows}: {recall:.3f}")
    assert len(found) == len(want) and recall >= 0.9


@pytest.mark.parametrize("rows", [500, 5000])
def test_a_forest_does_not_scan_all(rows):
    x = np.random.default_rng(3).standard_normal((rows, 64))
    forest = prefix_forest.Forest(np.arange(rows), x)
    low, high = forest.levels(prefix_forest.strings(prefix_forest.normed(x[:20]), prefix_forest.TREES, forest.length, 1))
    found = [forest.gathered(low[:, :, q], high[:, :, q], rows // 10) for q in range(20)]
    assert forest.length == 8 and all(level > 0 and len(own) < 0.6 * rows for level, own in found)


def test_deeper_levels_for_near_vectors():
    """Where a tenth of the rows are near, prefixes of several characters suffice."""
    random = np.random.default_rng(4)
    x = random.standard_normal((1000, 64))
    x[:150] = x[0] + 0.01 * random.standard_normal((150, 64))
    forest = prefix_forest.Forest(np.arange(1000), x)
    low, high = forest.levels(prefix_forest.strings(prefix_forest.normed(x[:5]), prefix_forest.TREES, forest.length, 1))
    for q in range(5):
        level, own = forest.gathered(low[:, :, q], high[:, :, q], 100)
        assert level >= 2 and set(own) <= set(range(150))


def test_repeated_rows(spark):
    """Equal rows are candidates of their own, but a query asked twice is answered once."""
    df = spark.createDataFrame([(0, [1.0, 0.0], "x", 1)] * 3 + [(1, [1.0, 0.1], "x", 1)] * 9 + [(2, [0.0, 1.0], "x", 1)], SCHEMA)
    found = prefix_forest.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in found] == [(i, 1) for i in range(1, 6)]
    one_id = spark.createDataFrame([(7, [float(i), 1.0], "x", 1) for i in range(2000)], SCHEMA)
    assert prefix_forest.nearest(one_id, one_id.where("embedding[0] = 0"), shard=100).count() == 0
    nothing = spark.createDataFrame([(1, None, "x", 1), (None, None, "x", 1)], SCHEMA)
    assert prefix_forest.nearest(nothing, nothing).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert prefix_forest.nearest(df, df).count() == 0
