"""Moments of all models against sums over each model's own rows."""

import numpy as np
import pytest

from effectgrid.operators import association, gram

INF, NAN = float("inf"), float("nan")


def frame(spark, rows, responses, predictors, parts=3):
    schema = "k string, id long, z double, " + ", ".join(f"{c} double" for c in [*predictors, *responses])
    return spark.createDataFrame(rows, schema).repartition(parts)


def some_rows(n, responses, predictors, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        values = rng.normal(loc=1e6, size=1 + len(responses) + len(predictors))
        values = [None if rng.random() < 0.1 else NAN if rng.random() < 0.05 else float(v) for v in values]
        rows.append((rng.choice(["hot", "hot", "hot", "b", "c"]).item() if i % 50 else None, i, *values))
    return rows


def plain(rows, responses, predictors):
    value = lambda v: np.array([NAN if x is None else x for x in v], float)
    out = {}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        z = value(r[2] for r in own)
        for a, p in enumerate(predictors):
            for b, q in enumerate(responses):
                x, y = value(r[3 + a] for r in own), value(r[3 + len(predictors) + b] for r in own)
                use = ~(np.isnan(x) | np.isnan(y) | np.isnan(z))
                m = np.stack([x[use], z[use], y[use]])
                c = np.cov(m, bias=True) * use.sum() if use.any() else np.zeros((3, 3))
                both = ~(np.isnan(x) | np.isnan(y))
                out[key, q, p] = [
                    (~np.isnan(x)).sum(), both.sum(), use.sum(), *(m.mean(axis=1) if use.any() else [0, 0, 0]),
                    c[0, 0], c[1, 1], c[2, 2], c[0, 1], c[0, 2], c[1, 2],
                ]
    return out


@pytest.mark.parametrize("n_responses,n_predictors", [(2, 3), (150, 18)])
def test_moments_against_each_models_rows(spark, n_responses, n_predictors):
    responses, predictors = [f"y{i}" for i in range(n_responses)], [f"x{i}" for i in range(n_predictors)]
    rows = some_rows(120, responses, predictors)
    found = gram.model_moments(frame(spark, rows, responses, predictors), ["k"], responses, predictors, "z")
    names = ["x_n", "pair_n", "n", "mx", "mz", "my", "xx", "zz", "yy", "xz", "xy", "zy"]
    expected = plain(rows, responses, predictors)
    got = {(r["k"], r["pathway"], r["predictor"]): [r[c] for c in names] for r in found.collect()}
    assert got.keys() == expected.keys()
    for key in got:
        np.testing.assert_allclose(got[key], expected[key], rtol=1e-7, atol=1e-6)


def test_tasks_that_pass_on_early_agree(spark, monkeypatch):
    rows = some_rows(300, ["y"], ["x"], 1)
    whole = gram.model_moments(frame(spark, rows, ["y"], ["x"], 1), ["k"], ["y"], ["x"], "z").collect()
    monkeypatch.setattr(gram, "HELD", 1)
    parts = gram.model_moments(frame(spark, rows, ["y"], ["x"], 7), ["k"], ["y"], ["x"], "z").collect()
    order = lambda t: sorted(t, key=lambda r: str(r["k"]))
    for a, b in zip(order(whole), order(parts)):
        np.testing.assert_allclose([a[c] for c in gram.PLANES], [b[c] for c in gram.PLANES], rtol=1e-9, atol=1e-7)


def test_infinite_values_spoil_their_own_models_only(spark):
    rows = [("a", i, float(i), float(i), float(i * i), float(i), 1.0 * i) for i in range(10)]
    rows[3] = ("a", 3, 3.0, INF, 9.0, 3.0, None)
    found = gram.model_moments(frame(spark, rows, ["y", "w"], ["x", "v"]), ["k"], ["y", "w"], ["x", "v"], "z")
    got = {(r["predictor"], r["pathway"]): r["xx"] for r in found.collect()}
    assert got["x", "y"] is None and got["x", "w"] is not None and got["v", "y"] is not None


def test_constant_columns_have_no_spread(spark):
    rows = [("a", i, float(i % 7), 0.1 if i else None, float(i)) for i in range(60)]
    found = gram.model_moments(frame(spark, rows, ["y"], ["x"], 4), ["k"], ["y"], ["x"], "z").first()
    assert found["x_xx"] == 0.0 and found["xx"] == 0.0
    # constant among the complete cases alone: a row of nulls, as before
    rows = [("a", i, float(i % 7), 0.1 if i > 9 else float(i), float(i) if i > 9 else None) for i in range(60)]
    fit = association.associate(frame(spark, rows, ["y"], ["x"], 4), ["k"], ["y"], ["x"], "z", "id").collect()
    assert len(fit) == 1 and fit[0]["estimate"] is None


def test_input_is_read_once_and_not_exploded(spark):
    rows = some_rows(60, ["y1", "y2"], ["x1", "x2", "x3", "x4", "x5"])
    df = frame(spark, rows, ["y1", "y2"], ["x1", "x2", "x3", "x4", "x5"])
    plan = gram.model_moments(df, ["k"], ["y1", "y2"], ["x1", "x2", "x3", "x4", "x5"], "z")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1


def test_empty_table(spark):
    assert gram.model_moments(frame(spark, [], ["y"], ["x"]), ["k"], ["y"], ["x"], "z").collect() == []
