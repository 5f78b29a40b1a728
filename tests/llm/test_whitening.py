"""Embedding whitening against numpy's own eigenvectors and exact integers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import bidiagonal, queries, whitening

VEC = "vec_id long, embedding array<float>"


def brute(rows):
    """vec_id -> (n, deviation, whitened, explained) by Python integers and a dense eigenvalue solver."""
    usable = [(i, [float(c) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, [int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v]) for i, v in usable]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * a - s for a, s in zip(v, sums)] for v in fit], dtype=float) / n
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    out = []
    for i, v in x:
        gap = [n * a - s for a, s in zip(v, sums)]
        out.append((i, n, sum(g * g for g in gap), (np.array(gap, dtype=float) / n) @ vectors / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()))
    return out


def check(got, want, k):
    assert len(got) == len(want) * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    signs = None
    for i, n, deviation, whitened, explained in want:
        rows = sorted(by[i], key=lambda r: r.component)[:k]
        assert [r.component for r in rows] == list(range(1, k + 1))
        assert {(r.n, r.deviation) for r in rows} == {(n, deviation)}
        mine = np.array([r.whitened for r in rows])
        if signs is None:
            signs = np.sign(mine * whitened[:k])
        assert np.allclose(mine, whitened[:k] * signs, rtol=1e-7, atol=1e-7)
        assert np.allclose([r.explained for r in rows], explained[:k], rtol=1e-9)
        assert rows[0].identity_error <= 1e-9


def test_given_embeddings_against_dense_solver(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(queries.op13_whitening(spark, sf).collect(), brute(rows), 16)


def test_repeats_and_unusable_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] + [0.0] * 4), (204, []), (205, [1.0, 2.0]), (206, [3e38] * 5)]
    df = spark.createDataFrame(rows + bad, VEC).withColumn("x", F.lit(1)).withColumn("n", F.lit(2)).repartition(5)
    got = whitening.whiten(df).collect()
    assert {r.vec_id for r in got} == {i for i, _ in rows}
    check(got, brute(rows), 5)
    twice = df.unionByName(df.where("vec_id = 3")).unionByName(df.where("vec_id = 4").withColumn("vec_id", F.lit(None).cast("long")))
    again = whitening.whiten(twice, count=2)
    assert again.where("vec_id = 3").count() == 4 and again.where("vec_id is null").count() == 2


def test_no_variance(spark):
    one = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], VEC)
    assert whitening.whiten(one).count() == 0
    none = whitening.whiten(one.where("false"))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = spark.createDataFrame([(i, [float(i), float(2 * i), 1.0]) for i in range(20)], VEC)
    got = whitening.whiten(flat)
    assert got.select("component").distinct().count() == 1 and got.first().identity_error < 1e-9


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(1 << 40) * (i % 7), float(i), 0.5 * i]) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.deviation is None or r.deviation >= 0 for r in got) and any(r.deviation is None for r in got)
    check([r for r in got if r.component == 1 and r.deviation is not None],
          [w for w in brute(rows) if w[2] < 1 << 63], 1)


@pytest.mark.parametrize("name", ["plain", "graded", "graded up", "clusters", "tight", "identity", "one", "repeated columns", "zero"])
def test_bidiagonal_solver(name):
    rng = np.random.default_rng(7)
    q1, q2 = (np.linalg.qr(rng.standard_normal((40, 40)))[0] for _ in range(2))
    steps = np.concatenate((np.full(3, 3.0), np.full(9, 2.0), np.ones(28)))
    a = {
        "plain": rng.standard_normal((40, 40)),
        "graded": np.linalg.qr(rng.standard_normal((200, 40)) * np.logspace(0, -9, 40), mode="r"),
        "graded up": np.linalg.qr(rng.standard_normal((200, 40)) * np.logspace(-9, 0, 40), mode="r"),
        "clusters": q1 @ np.diag(steps) @ q2.T,
        "tight": q1 @ np.diag(1 + 1e-11 * np.arange(40)) @ q2.T,
        "identity": np.eye(40), "one": np.ones((40, 40)),
        "repeated columns": np.repeat(rng.standard_normal((40, 8)), 5, axis=1),
        "zero": np.zeros((40, 40)),
    }[name]
    d, e, right = bidiagonal.bidiagonalise(a)
    top = max(np.linalg.norm(a, 2), 1e-300)
    assert np.abs(right.T @ right - np.eye(40)).max() < 1e-13
    want = np.linalg.svd(a, compute_uv=False)
    assert np.abs(np.sqrt(bidiagonal.singular_squares(d, e)) - want).max() <= 1e-14 * 40 * top
    values, vectors = bidiagonal.principal(a, 16)
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-8
    assert np.abs(a.T @ a @ vectors - vectors * values).max() <= 1e-13 * 40 * top ** 2


def test_small_singular_values_keep_their_digits():
    """Relative accuracy: the square of the least value is far below what a formed covariance resolves."""
    d, e = np.array([1.0, 1e-4, 1e-8, 1e-12]), np.array([0.5, 1e-5, 1e-9])
    found = np.sqrt(bidiagonal.singular_squares(d, e))
    assert np.isclose(np.prod(found), np.prod(d), rtol=1e-12) and found[-1] < 1e-11
