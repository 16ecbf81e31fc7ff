from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import whitening as W
from plumbline.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(vectors, keep=8):
    """n, deviations, whitened (up to sign), explained by one dense decomposition."""
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    far = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = x - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:keep], basis[:, ::-1][:, :keep]
    return n, far, centred @ basis / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check(found, ids, vectors):
    n, far, white, explained = brute(vectors)
    rows = {(r.vec_id, r.component): r for r in found}
    assert len(rows) == len(found) == len(ids) * white.shape[1]
    for k in range(white.shape[1]):
        ours = np.array([rows[i, k + 1].whitened for i in ids])
        sign = np.sign(ours @ white[:, k])
        np.testing.assert_allclose(ours, sign * white[:, k], atol=1e-8)
    for at, i in enumerate(ids):
        row = rows[i, 1]
        assert (row.n, row.deviation) == (n, far[at]) and row.identity_error < 1e-9
        assert abs(row.explained - explained[0]) < 1e-9


def test_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    check(QUERIES["op12_whitening"](spark, folder).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_partitions_and_merges(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(40)  # two rounds of merges
    check(W.whitened(df).collect(), list(range(400)), vectors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 3.0], 0), (2, None, 0), (3, [1.0, None, 3.0], 0), (4, [nan, 1.0, 2.0], 0),
        (5, [1.0, inf, 2.0], 0), (6, [], 0), (7, [1.0, 2.0], 0), (8, [0.0, -1.0, 5.5], 0),
        (None, [2.0, 2.5, 0.25], 0), (9, [2.0, -7.0, 1.0], 0), (9, [2.0, -7.0, 1.0], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS x", "'a' AS EMBEDDING")
    found = W.whitened(df).collect()
    kept = [r for r in rows if r[0] in (1, 8, None, 9)]
    n, far, white, _ = brute([r[1] for r in kept], 3)
    assert n == 5 and len(found) == 15
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(far)
    seen = sorted(abs(r.whitened) for r in found)
    np.testing.assert_allclose(seen, sorted(np.abs(white).ravel()), atol=1e-8)


def test_nothing_to_whiten(spark):
    """Empty tables, single rows and equal vectors have no component."""
    for rows in ([], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(30)], [(1, None, 0)]):
        assert W.whitened(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_flat_directions_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(50)]
    found = W.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in found} == {1}


@pytest.mark.parametrize("d", [1, 2, 5, 16])
def test_updates_equal_a_dense_decomposition(d):
    rng = np.random.default_rng(d)
    x = rng.integers(-3, 4, (200, d)) if d % 2 else rng.integers(90_000, 110_000, (200, d))
    x[20:60] = x[19]  # terms that repeat
    whole, first, second = (W.Spectrum(d) for _ in range(3))
    whole.add(x)
    first.add(x[:77])
    second.add(x[77:])
    first.merge(second)
    centred = x - x.mean(0)
    scatter = centred.T @ centred
    for found in (whole, first):
        scale = np.abs(scatter).max()
        assert np.abs(found.vectors * found.values @ found.vectors.T - scatter).max() < 1e-11 * scale
        assert np.abs(found.vectors.T @ found.vectors - np.eye(d)).max() < 1e-10
        assert found.n == 200 and found.sums == x.sum(0).tolist()


def test_roots_lie_between_the_poles():
    rng = np.random.default_rng(0)
    for _ in range(200):
        d = np.unique(rng.random(int(rng.integers(1, 9))) * 10.0 ** rng.integers(-6, 6))
        z = rng.normal(size=len(d)) * 10.0 ** rng.integers(-4, 4)
        pole, distance = W.secular_roots(d, z)
        exact = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        np.testing.assert_allclose(d[pole] + distance, exact, rtol=1e-9, atol=1e-12 * (exact[-1] + 1))


def test_deviations_are_exact_or_null():
    x = np.array([[3, 5], [10**9, 7]], np.int64)
    sums, n = [10**6, 12], 10**5
    found = W.deviations(x, n, sums)
    exact = [int(sum(Fraction(n * int(c) - s) ** 2 for c, s in zip(row, sums))) for row in x]
    assert found == [exact[0], None] and exact[1] >= 2**63
