"""Whitening against numpy's eigenvectors."""

import numpy as np

from kinweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain_whitening(rows, k=4):
    """{vec_id: (deviation, [whitened up to sign])}, explained."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in usable], np.float32).astype(float)).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    z = fit - s / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > values[0] * 1e-12).sum()))
    w = (x - s / n) @ vectors[:, :k] / np.sqrt(values[:k])
    deviation = [sum(int(c) ** 2 for c in row) for row in (n * x - s)]
    return n, {i: (deviation[j], w[j]) for j, (i, _) in enumerate(usable)}, values[:k] / values.sum()


def check(spark, rows, **more):
    n, want, explained = plain_whitening(rows)
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect()
    k = len(explained)
    assert sorted((r.vec_id, r.component) for r in got) == [(i, c + 1) for i in sorted(want) for c in range(k)]
    signs = np.zeros(k)
    for r in got:
        signs[r.component - 1] += r.whitened * want[r.vec_id][1][r.component - 1]
    for r in got:
        deviation, w = want[r.vec_id]
        assert r.n == n and int(r.deviation) == deviation
        assert abs(r.whitened * np.sign(signs[r.component - 1]) - w[r.component - 1]) < 1e-9
        assert abs(r.explained - explained[r.component - 1]) < 1e-12
        assert r.identity_error < 1e-9
    return got


def test_components_are_those_of_the_covariance(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 9)) * [3, 1, 2, 0.3, 0.2, 0.5, 0.1, 0.1, 1]
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))]
    rows += [(1000 + k, rows[5][1]) for k in range(200)]  # a vector of two fifths of all rows counts once
    check(spark, rows)


def test_fewer_dimensions_than_vectors_seem_to_have(spark):
    rng = np.random.default_rng(3)
    two = rng.integers(-9, 9, (80, 2))
    x = np.concatenate([two, two[:, :1] + two[:, 1:], np.ones((80, 1))], 1) / 8
    got = check(spark, [(k, v.tolist()) for k, v in enumerate(x)])
    assert {r.component for r in got} == {1, 2}


def test_unusable_vectors_are_left_out(spark):
    rng = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(40, 3)).astype(np.float32))]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [1.0, float("inf"), 2.0])]
    check(spark, rows + odd)
    assert {r.vec_id for r in whitening.whitened(spark.createDataFrame([*rows, (105, [1.0]), (106, [1e30, 0.0, 0.0])], SCHEMA)).collect()} == set(range(40))
    nulls = spark.createDataFrame([(None, v, 1, "x") for _, v in rows], "`v.id` long, embedding array<float>, n int, component string")
    assert whitening.whitened(nulls, id_col="v.id").filter("vec_id is null").count() == 120
    assert whitening.whitened(spark.createDataFrame(odd, SCHEMA)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect() == []
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_is_exact_beyond_a_long(spark):
    rows = [(k, [float(v) for v in x]) for k, x in enumerate(np.random.default_rng(5).integers(-4_000_000, 4_000_000, (200, 2)))]
    check(spark, rows)


def test_factor_and_rotations():
    rng = np.random.default_rng(6)
    for d, r in ((1, 1), (2, 2), (7, 4), (24, 24), (33, 20)):
        g = rng.normal(size=(d, r)) * np.logspace(0, -5, r)
        a = g @ g.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape[1] <= r and np.abs(factor @ factor.T - a).max() < 1e-12 * max(1, np.abs(a).max())
        values, vectors = whitening.one_sided_jacobi(factor)
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1][: len(values)]).max() < 1e-12 * values[0]
