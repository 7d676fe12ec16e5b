from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from parlance.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, size int"


def exact_fit(rows):
    """(fit list, n, S, V) by fractions; V's entries rounded at the end."""
    fit = sorted(set(map(tuple, rows)))
    n, size = len(fit), len(fit[0])
    mean = [Fraction(sum(r[i] for r in fit), n) for i in range(size)]
    v = [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in fit) / n for j in range(size)] for i in range(size)]
    return fit, n, mean, np.array([[float(e) for e in row] for row in v])


def integers(vector):
    return [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in vector]


def expected(vectors):
    """{vec_id: (n, deviation)}, V's eigenvalues falling, and the fit."""
    rows = {i: integers(v) for i, v in vectors}
    fit, n, mean, v = exact_fit(rows.values())
    return {i: (n, sum((n * (c - m)) ** 2 for c, m in zip(x, mean))) for i, x in rows.items()}, rows, fit, mean, v


def check(found, vectors, most=16):
    deviations, rows, fit, mean, v = expected(vectors)
    values = np.linalg.eigvalsh(v)[::-1]
    centred = {i: np.array([float(c - m) for c, m in zip(x, mean)]) for i, x in rows.items()}
    assert {(r["vec_id"], r["n"], r["deviation"]) for r in found} == {(i, *d) for i, d in deviations.items()}
    white = np.array([r["whitened"] for r in sorted(found, key=lambda r: r["vec_id"])], float)
    x = np.array([centred[i] for i in sorted(centred)])
    kept = min(most, len(v), int((values > values[0] * 1e-12).sum()))
    assert white.shape[1] == min(most, len(v)) and not np.isnan(white[:, :kept]).any() and np.isnan(white[:, kept:]).all()
    # projections on unit eigenvectors: V e = lambda e, found back from the whitened rows by least squares
    by_id = dict(zip(sorted(centred), white))
    own = np.array([by_id[next(i for i in rows if tuple(rows[i]) == f)] for f in fit])[:, :kept]
    assert np.abs(own.T @ own / len(fit) - np.eye(kept)).max() < 1e-6
    for k in range(kept):
        e = np.linalg.lstsq(x, white[:, k] * np.sqrt(values[k]), rcond=None)[0]
        assert np.allclose(v @ e, values[k] * e, atol=1e-6 * values[0])
        assert all(abs(r["explained"][k] - values[k] / np.trace(v)) <= 1e-4 * values[k] / np.trace(v) for r in found)
    assert all(r["identity_error"] < 1e-6 for r in found)


@pytest.mark.parametrize("rows,size", [(60, 5), (40, 20), (9, 12), (3, 1)])
def test_against_fractions(spark, rows, size):
    random = np.random.default_rng(rows)
    vectors = [(i, random.standard_normal(size).astype(np.float32).tolist()) for i in range(rows)]
    vectors += [(100 + i, vectors[i % 2][1]) for i in range(30)]  # a large group of equal vectors
    odd = [(900, None), (901, [None] + [1.0] * (size - 1)), (902, [float("nan")] * size), (903, [float("inf")] * size)]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in vectors + odd], SCHEMA)
    check(whitening.whiten(df, whitening.train(df)).collect(), vectors)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty, whitening.train(empty)).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0], "a", 1), (None, [1.0, 2.0], "a", 1), (2, [5.0], "a", 1), (3, [], "a", 1)], SCHEMA)
    found = whitening.whiten(one, whitening.train(one)).collect()
    assert sorted((r["vec_id"] or 0, r["n"], int(r["deviation"]), len(r["whitened"])) for r in found) == [(0, 1, 0, 2), (1, 1, 0, 2), (2, 1, 0, 1), (3, 1, 0, 0)]
    assert all(w is None for r in found for w in r["whitened"])


def test_large_numbers_stay_exact(spark):
    vectors = [(i, [3.0e7 * (i * i % 7), 1.0e12 * i, 2.0e17 * (i % 3)]) for i in range(6)] + [(7, [1.0e300, -1.0e300, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = [tuple(int(np.floor(max(-(2.0**61), min(2.0**61, 64 * c)))) + 1_000_000 for c in v) for _, v in vectors]
    n, sums, products = whitening.scatter(whitening.lattice(df).select("x").distinct(), 1_000_000)[3]
    y = [[c - 1_000_000 for c in r] for r in rows]
    assert (n, sums) == (len(rows), [sum(c) for c in zip(*y)])
    assert products == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df, whitening.train(df)).collect()}
    for (i, _), row in zip(vectors, y):
        exact = sum((n * c - s) ** 2 for c, s in zip(row, sums))
        assert found[i] == (exact if exact < 10**38 else None)


def test_cross_products_of_wide_integers():
    y = np.random.default_rng(1).integers(-(1 << 61), 1 << 61, (whitening.BLOCK + 3, 3))
    exact = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)]
    assert whitening.cross_products(y).tolist() == exact


def test_query(spark):
    found = queries.op11_exact_whitening(spark, "/root/testdata/sf0.001").toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    deviations, *_, v = expected([(r["vec_id"], r["embedding"]) for r in rows])
    assert len(found) == 16 * len(rows) and sorted(found["component"].unique()) == list(range(1, 17))
    assert {(r.vec_id, r.n, r.deviation) for r in found.itertuples()} == {(i, *map(int, d)) for i, d in deviations.items()}
    values = np.linalg.eigvalsh(v)[::-1][:16]
    assert np.allclose(found.groupby("component")["explained"].first(), values / np.trace(v), rtol=1e-9)
    assert found["identity_error"].max() < 1e-6 and isinstance(found, pd.DataFrame)
