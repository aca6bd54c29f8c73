"""Whitening against exact rational arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, v string, whitened int, `at` int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "k", 1, 2) for i, v in rows], SCHEMA).repartition(parts)


def plain(vectors):
    """n, S and n XᵀX - SSᵀ in Python's integers, shift included."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    return x, n, s, [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


def test_query(spark, sf):
    got = queries.op12_whitening(spark, sf).toPandas()
    own = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x, n, s, exact = plain([r.embedding for r in own])
    cov = np.array([[float(Fraction(e, n * n)) for e in row] for row in exact])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == n * 32 and set(got.n) == {n} and got.component.dtype == "int32"
    assert got.groupby("component").explained.first().to_numpy() == pytest.approx(e[:32] / np.trace(cov), rel=1e-9)
    assert dict(zip(got.vec_id, got.deviation, strict=True)) == {r.vec_id: sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for r, row in zip(own, x, strict=True)}
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(row, s, strict=True)] for row in x]) @ u[:, :32] / np.sqrt(e[:32])
    assert np.abs(z * np.sign((z * want).sum(0)) - want).max() < 1e-8
    error = np.abs(np.cov(z.T, bias=True) - np.eye(32)).max()
    assert got.identity_error.max() < 1e-10 and error < 1e-10


def test_sums_are_exact_for_any_size():
    rng = np.random.default_rng(2)
    for reach in (3, 1 << 20, 1 << 21, 1 << 40, 1 << 62):
        y = rng.integers(-reach, reach, (50, 4))
        y[0], y[1] = -reach, reach
        sums, products = whitening.scatter(y)
        rows = y.astype(object)
        assert sums.tolist() == rows.sum(0).tolist() and products.tolist() == (rows.T @ rows).tolist()
    full = np.full((whitening.ROWS, 2), 1 << 20)
    assert whitening.scatter(full)[1].tolist() == [[whitening.ROWS << 40] * 2] * 2


def test_unfit_vectors_and_extremes(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(0, 1, 3).tolist()) for i in range(40)] + [(3, [0.5, 0.5, 0.5]), (None, [1.0, 2.0, 3.0])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, math.nan, 2.0]), (104, [math.inf, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1.0] * 4)]
    fit = whitening.fit(frame(spark, good + bad))
    assert fit.n == len(good) and fit.dims == 3 and len(fit.values) == 3
    got = fit.transform(frame(spark, good + bad)).collect()
    assert sorted((r.vec_id for r in got), key=repr) == sorted((i for i, _ in good), key=repr)
    again = whitening.fit(frame(spark, good[::-1] + bad, 7))
    assert again.sums == fit.sums and again.values.tolist() == fit.values.tolist() and again.vectors.tolist() == fit.vectors.tolist()
    assert whitening.fit(frame(spark, bad[:5])) is None and whitening.fit(frame(spark, [])) is None
    same = whitening.fit(frame(spark, [(i, [1.0, 2.0]) for i in range(5)]))
    assert len(same.values) == 0 and same.transform(frame(spark, [(1, [1.0, 2.0])])).first().whitened == [] and same.identity_error(frame(spark, [(1, [1.0, 2.0])])) == 0
    flat = whitening.fit(frame(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)]))  # of rank one
    assert len(flat.values) == 1 and flat.identity_error(frame(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])) < 1e-9


def test_huge_entries(spark):
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [3e15, -4.0]), (3, [0.25, 0.0])]
    fit = whitening.fit(frame(spark, rows))
    limit = (1 << 63) - 1 - 1_000_000
    y = [[limit, 64], [-limit, 128], [64 * 3 * 10**15, -256], [16, 0]]
    s = [sum(r[i] for r in y) for i in range(2)]
    assert fit.sums == tuple(s)
    got = {r.vec_id: r for r in fit.transform(frame(spark, rows)).collect()}
    want = [sum((4 * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in y]
    assert all(got[i].deviation == (w if w < 1 << 63 else None) for i, w in enumerate(want)) and all(np.isfinite(got[i].whitened).all() for i in got)


def test_far_from_the_origin(spark):
    """A shift and an offset that would cost doubles their digits cost nothing here."""
    rng = np.random.default_rng(5)
    near = [(i, v) for i, v in enumerate(rng.normal(0, 1, (300, 4)).tolist())]
    moved = frame(spark, near).withColumn("embedding", F.transform("embedding", lambda c: F.floor(64 * c).cast("double") / 64 + 1e9))
    a, b = whitening.fit(frame(spark, near)), whitening.fit(moved, shift=-12345)
    assert a.values.tolist() == b.values.tolist() and a.vectors.tolist() == b.vectors.tolist()
