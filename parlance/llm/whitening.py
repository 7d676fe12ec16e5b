"""Embedding whitening from an exact integer scatter.

A component c of a vector becomes the integer x = floor(scale * c) + offset. The fit list holds each distinct x vector once. Tasks
subtract a shift (the offset) and accumulate sums S and cross-products as integers of any size: a block's numbers are split into
digits of 20 bits, whose products a float matrix multiplication adds up without rounding. What tasks have
found is summed by Spark as decimal digits of 40 bits, so that neither size nor number of rows ends the exactness. Of
n * X'X - SS' only the quotient by n^2 is rounded, once per entry, to the covariance V, which eigh decomposes.

The same covariance and components serve all rows: a row's whitened components are (x - S/n) projected on V's unit eigenvectors, by
falling eigenvalue, over the eigenvalue's root. A second pass over the fit list gives the whitened vectors' own covariance and how far it
is from the identity.

Equal vectors meet after partial aggregation, so a vector that many rows share is one row per task. The fit list is written to
the shared folder, read twice, and removed. The driver gets numbers of the order of the dimension's square.

Defined results: vectors that are null or hold null or non-finite components take no part. Vectors of each length have
a fit of their own. Components are numbered from 1; those whose eigenvalue is 0 but for rounding (at most length * 2^-52 of
the largest) explain a share of 0 and are null when whitened. An eigenvector's entry of the largest absolute value is positive.
Numbers beyond 2^61 are taken as 2^61. A deviation beyond 38 digits is null. Null and repeated ids are rows like others. Other columns
are left out. An empty table gives an empty result, and vectors of length 0 no components.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import remove, scratch

SCALE, OFFSET, LARGEST = 64.0, 1_000_000, 2.0**61
DIGIT, LIMB, BLOCK = 20, 40, 4096


@dataclass
class Fit:
    """Of vectors of one length: how many, their sums less the offset, and the components as columns."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - S, exactly: 64-bit integers where they suffice, else of any size."""
        most = max(map(abs, self.sums), default=0) + self.n * int(np.abs(y).max(initial=0))
        if most >= 1 << 62:
            y = y.astype(object)
            return self.n * y - np.array(self.sums, object)
        return self.n * y - np.array(self.sums, np.int64)

    def whiten(self, y: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (self.centred(y) / self.n).astype(float) @ self.components / np.sqrt(self.values)
        out[:, self.values == 0] = np.nan
        return out


def lattice(vectors: DataFrame, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform(e, lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c * scale))) + F.lit(offset).cast("long"))
    return vectors.where(F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the lists of each length."""
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        yield own, flat[starts[own][:, None] + np.arange(size)]


def digits(y: np.ndarray) -> list[np.ndarray]:
    """`y` as signed digits of DIGIT bits, lowest first."""
    out, half = [], 1 << (DIGIT - 1)
    while True:
        low = ((y + half) & ((1 << DIGIT) - 1)) - half
        out.append(low.astype(float))
        y = (y - low) >> DIGIT
        if not y.any():
            return out


def cross_products(y: np.ndarray) -> np.ndarray:
    """y'y of integers, exactly: products of digits stay below 2^38, and BLOCK of them below 2^53."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for k in range(0, len(y), BLOCK):
        own = digits(y[k : k + BLOCK])
        for i, a in enumerate(own):
            for j, b in enumerate(own):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << DIGIT * (i + j))
    return total


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of `value` in digits of LIMB bits with its sign."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield place, sign * (value & ((1 << LIMB) - 1))
        value, place = value >> LIMB, place + 1


SCATTER = "size int, i int, j int, place int, digit long"


def scatter(fit_list: DataFrame, offset: int) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """For each length: n, sums and cross-products of x - offset."""

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict = defaultdict(int)
        sums: dict = {}
        products: dict = {}
        for batch in rows:
            for _, x in by_length(batch.column("x")):
                y, size = x - offset, x.shape[1]
                n[size] += len(y)
                # two halves of 32 bits, so that a batch's sums can't overflow
                part = (y >> 32).sum(axis=0).astype(object) * (1 << 32) + (y & 0xFFFFFFFF).sum(axis=0).astype(object)
                sums[size] = part + sums.get(size, 0)
                products[size] = cross_products(y) + products.get(size, 0)
        out = [(size, -1, -1, place, digit) for size in n for place, digit in limbs(n[size])]
        for size in n:
            out += [(size, i, -1, *limb) for i, v in enumerate(sums[size]) for limb in limbs(int(v))]
            out += [(size, i, j, *limb) for i in range(size) for j in range(i + 1) for limb in limbs(int(products[size][i, j]))]
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()])], names=["size", "i", "j", "place", "digit"])

    found = fit_list.mapInArrow(task, SCATTER).groupBy("size", "i", "j", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit"))
    values: dict = defaultdict(int)
    for r in found.collect():
        values[r["size"], r["i"], r["j"]] += int(r["digit"]) << (LIMB * r["place"])
    return {
        size: (n, [values.get((size, i, -1), 0) for i in range(size)], [[values.get((size, max(i, j), min(i, j)), 0) for j in range(size)] for i in range(size)])
        for (size, i, _), n in list(values.items()) if i < 0
    }


def decompose(n: int, sums: list[int], products: list[list[int]], most: int) -> Fit:
    """The covariance, whose entries are the only rounded numbers, and its leading eigenvectors."""
    size = len(sums)
    exact = [[n * products[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    values, vectors = np.linalg.eigh(np.array([[v / (n * n) for v in row] for row in exact]).reshape(size, size))
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    values = np.where(values > values.max(initial=0) * size * 2.0**-52, values, 0.0)
    largest = np.abs(vectors).argmax(axis=0) if size else np.zeros(0, int)
    vectors = vectors * np.where(vectors[largest, np.arange(len(largest))] < 0, -1.0, 1.0)
    trace = sum(exact[i][i] for i in range(size)) / (n * n)
    return Fit(n, sums, vectors, values, values / trace if trace else values)


def identity_errors(fit_list: DataFrame, fits: dict[int, Fit], offset: int) -> dict[int, float]:
    """For each length the largest absolute entry of the whitened fit list's covariance less the identity."""

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = defaultdict(float)
        for batch in rows:
            for _, x in by_length(batch.column("x")):
                w = fits[x.shape[1]].whiten(x - offset)
                sums[x.shape[1]] += np.vstack([w.sum(axis=0), w.T @ w])
        out = [(size, i - 1, j, v) for size, own in sums.items() for (i, j), v in np.ndenumerate(own) if v == v]
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [pa.float64()])], names=["size", "i", "j", "v"])

    sums = {(r["size"], r["i"], r["j"]): r["v"] for r in fit_list.mapInArrow(task, "size int, i int, j int, v double").groupBy("size", "i", "j").agg(F.sum("v").alias("v")).collect()}
    worst: dict[int, float] = defaultdict(float)
    for (size, i, j), v in sums.items():
        if i >= 0:
            n = fits[size].n
            worst[size] = max(worst[size], abs(v / n - sums[size, -1, i] / n * (sums[size, -1, j] / n) - (i == j)))
    return worst


def train(vectors: DataFrame, components: int = 16, scale: float = SCALE, offset: int = OFFSET) -> dict[int, Fit]:
    """A fit for each length of vectors, with at most `components` components."""
    spark = vectors.sparkSession
    folder = scratch(spark, "whitening")
    lattice(vectors, scale, offset).select("x").distinct().write.parquet(folder)
    fit_list = spark.read.parquet(folder)
    fits = {size: decompose(*found, components) for size, found in scatter(fit_list, offset).items()}
    for size, error in identity_errors(fit_list, fits, offset).items():
        fits[size].error = error
    remove(spark, folder)
    return fits


WHITENED = "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"


def whiten(vectors: DataFrame, fits: dict[int, Fit], scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """A row of WHITENED for every vector that takes part.

    deviation: the squared length of n*x - S, exactly; whitened and explained have an entry per component.
    """
    lists, number = pa.list_(pa.float64()), pa.decimal128(38, 0)

    def deviations(centred: np.ndarray) -> pa.Array:
        most = int(np.abs(centred).max(initial=0))
        if most * most * max(1, centred.shape[1]) < 1 << 63:
            own = centred.astype(np.int64)
            return pa.array((own * own).sum(axis=1)).cast(number)
        exact = [sum(int(v) ** 2 for v in row) for row in centred]
        return pa.array([Decimal(v) if v < 10**38 else None for v in exact], number)

    def rows_of(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        fit, n = fits[x.shape[1]], len(x)
        white = fit.whiten(x - offset)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * white.shape[1])
        columns = [
            ids, pa.array(np.full(n, fit.n)), deviations(fit.centred(x - offset)),
            pa.ListArray.from_arrays(offsets, pa.array(white.ravel(), from_pandas=True)),
            pa.ListArray.from_arrays(offsets, pa.array(np.tile(fit.explained, n))),
            pa.array(np.full(n, fit.error)),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(zip(("vec_id", "n", "deviation", "whitened", "explained", "identity_error"), (pa.int64(), pa.int64(), number, lists, lists, pa.float64())))))

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for own, x in by_length(batch.column("x")):
                for k in range(0, len(own), BLOCK):
                    yield rows_of(batch.column("vec_id").take(pa.array(own[k : k + BLOCK])), x[k : k + BLOCK])

    return lattice(vectors, scale, offset).mapInArrow(task, WHITENED)
