import numpy as np

from effectgrid.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component string"


def plain(vectors, k=4):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = (n * fit - total) / n
    _, values, vecs = np.linalg.svd(centred / np.sqrt(n), full_matrices=False)
    kept = sum(values[:k] > 1e-13 * values[0])
    w = ((n * x - total) / n) @ vecs[:kept].T / values[:kept]
    return n, ((n * x - total) ** 2).sum(axis=1), w, values[:kept] ** 2 / (values**2).sum()


def run(spark, vectors, **options):
    rows = [(i, [float(c) if c is not None else None for c in v] if v is not None else None, "x") for i, v in enumerate(vectors)]
    out = whitening.whitened(spark.createDataFrame(rows, SCHEMA), **options)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return sorted(out.collect(), key=lambda r: (r.vec_id, r.component))


def check(got, vectors, ids):
    n, deviation, w, explained = plain(vectors)
    k = w.shape[1]
    assert [(r.vec_id, r.component) for r in got] == [(i, c + 1) for i in ids for c in range(k)]
    assert {r.n for r in got} == {n} and [r.deviation for r in got[::k]] == deviation.tolist()
    mine = np.array([r.whitened for r in got]).reshape(-1, k)
    np.testing.assert_allclose(mine, w * np.sign((mine * w).sum(axis=0)), atol=1e-8)
    np.testing.assert_allclose([r.explained for r in got[:k]], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6


def test_against_eigenvectors_with_copies(spark):
    rng = np.random.default_rng(3)
    vectors = [*(rng.normal(size=(300, 12)) * np.geomspace(3, 0.05, 12)), *([rng.normal(size=12)] * 150)]
    check(run(spark, vectors), vectors, range(450))


def test_badly_conditioned_and_rank_deficient(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 3))
    far = [np.r_[v * [1e3, 1.0, 0.05], v[0] * 1e3, 7.0] for v in base]
    check(run(spark, far), far, range(200))
    few = [[1.0, 0, 0, 0, 0], [0, 1.0, 0, 0, 0], [0, 0, 5.0, 0, 0]]
    check(run(spark, few), few, range(3))  # two components only


def test_rows_left_out(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1, -0.2], [0.5, 0.25], [-1.0, 2.0], [0.1, -0.2]]
    bad = [None, [None, 1.0], [nan, 1.0], [inf, 1.0], [1.0, -inf], [], [1.0], [1.0, 2.0, 3.0]]
    got = run(spark, good + bad)
    check(got, good, range(4))
    assert run(spark, bad[:6]) == [] and run(spark, []) == []
    assert run(spark, [[1.0, 2.0]] * 5) == []


def test_large_entries_stay_exact(spark):
    vectors = [[2.0**36 + i, -(2.0**36) * i] for i in range(1, 6)]
    x = [[int(256 * c) for c in v] for v in vectors]
    total = [sum(c) for c in zip(*x)]
    exact = [sum((5 * a - s) ** 2 for a, s in zip(v, total)) for v in x]
    got = run(spark, vectors, components=1)
    assert [r.deviation for r in got] == [e if e < 2**63 else None for e in exact]


def test_triangular_solve_and_factor():
    rng = np.random.default_rng(5)
    r = np.triu(rng.normal(size=(6, 6))) + 4 * np.eye(6)
    rows = rng.normal(size=(9, 6))
    np.testing.assert_allclose(whitening.solved(rows, r) @ r, rows, atol=1e-12)
    singular = np.ones((4, 4))
    f = whitening.factor(singular, 0.0)
    np.testing.assert_allclose(f.T @ f, singular, atol=1e-12)
