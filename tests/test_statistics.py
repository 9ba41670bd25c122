import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from helpers import close, keyed, plan
from pyspark.sql import functions as F

from effectgrid.operators import association, contrast, fdr, fisher, mixed, quantiles, ranges


def exact_fisher(a, b, c, d):
    r1, r2, c1 = a + b, c + d, a + c
    total = math.comb(r1 + r2, c1)
    weights = {k: math.comb(r1, k) * math.comb(r2, c1 - k) for k in range(max(0, c1 - r2), min(r1, c1) + 1)}
    return sum(w for w in weights.values() if w * 10**7 <= weights[a] * (10**7 + 1)) / total


def test_fisher_exact(spark):
    tables = [(3, 7, 9, 2), (0, 5, 4, 0), (0, 0, 3, 4), (10, 0, 10, 0), (5, 5, 5, 5), (120, 4000, 200, 3900),
              (1, 9, 11, 3), (3, 1, 1, 3), (300, 260, 290, 310)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    for r in fisher.fisher_2x2(df, "a", "b", "c", "d").collect():
        assert close(r.p, exact_fisher(r.a, r.b, r.c, r.d), 1e-8), r
    flipped = fisher.fisher_2x2(df.select(F.col("a"), F.col("c").alias("b"), F.col("b").alias("c"), "d"), "a", "b", "c", "d")
    assert np.allclose(sorted(r.p for r in flipped.collect()),
                       sorted(r.p for r in fisher.fisher_2x2(df, "a", "b", "c", "d").collect()), rtol=1e-9)


def test_fisher_large_margins(spark):
    """A support of several blocks, against log-gamma sums."""
    a, b, c, d = 7000, 6000, 6500, 7100
    r1, r2, c1 = a + b, c + d, a + c
    lg = lambda k: -sum(math.lgamma(v + 1) for v in (k, r1 - k, c1 - k, r2 - c1 + k))
    ks = range(max(0, c1 - r2), min(r1, c1) + 1)
    w = np.exp(np.array([lg(k) for k in ks]) - lg(a))
    df = spark.createDataFrame([(a, b, c, d), (1, 2, 3, 4)], "a long, b long, c long, d long")
    got = keyed(fisher.fisher_2x2(df, "a", "b", "c", "d"), "a")
    assert len(w) > 10_000 and close(got[a].p, w[w <= 1 + 1e-7].sum() / w.sum(), 1e-6)


def test_enrichment_keeps_totals_without_hits(spark):
    totals = spark.createDataFrame([("a", "female", 10), ("a", "male", 12), ("b", "female", 5)], "cell_major string, sex string, n_total long")
    hits = spark.createDataFrame([("a", "female", 4), (None, "male", 3)], "cell_major string, sex string, n_sig long")
    got = keyed(fisher.enrichment(totals, hits), "cell_major")
    a, b = got["a"], got["b"]
    assert (a.a, a.b, a.c, a.d) == (4, 6, 0, 12) and (b.a, b.b, b.c, b.d) == (0, 5, 0, 0)
    assert close(a.pval, exact_fisher(4, 6, 0, 12)) and close(a.logOR, math.log(4.5 * 12.5 / (6.5 * 0.5)))
    assert set(got) == {"a", "b"}


def bh(ps):
    known = sorted(p for p in ps if p is not None)
    n = len(known)
    return [None if p is None else min(1, min(q * n / sum(v <= q for v in known) for q in known if q >= p)) for p in ps]


def test_bh_both_forms(spark):
    rng = np.random.default_rng(3)
    ps = [None, 0.0, 1.0, 1.0, 0.04, 0.04] + [float(p) for p in rng.random(200) ** 3] + [1e-12, 1e-280, 0.3]
    data = [(g, i, p) for g in ("x", "y", None) for i, p in enumerate(ps if g != "y" else ps[::3])]
    df = spark.createDataFrame(data, "g string, i int, p double").repartition(3)
    expected = {}
    for g in ("x", "y", None):
        own = [p for h, _, p in data if h == g]
        expected.update({(g, i): q for i, q in enumerate(bh(own))})
    for bound in (None, 1000):
        got = keyed(fdr.bh_adjust(df, "p", ["g"], max_group_rows=bound), "g", "i")
        assert len(got) == len(data)
        for k, q in expected.items():
            assert close(got[k].FDR, q, 1e-12), (bound, k)
            assert q is None or got[k].FDR >= got[k].p
    flat = bh([p for _, _, p in data])
    for bound in (None, 5000):
        got = keyed(fdr.bh_adjust(df, "p", max_group_rows=bound), "g", "i")
        assert all(close(got[(g, i)].FDR, q, 1e-12) for (g, i, _), q in zip(data, flat))


def test_bh_windows_run_in_one_direction(spark):
    """A frame open towards the end is recomputed per row; none may be left."""
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2)], "g string, p double")
    for bound in (None, 10):
        text = plan(fdr.bh_adjust(df, "p", ["g"], max_group_rows=bound)).lower()
        assert "window" in text and "currentrow$(), unboundedfollowing" not in text


def test_bh_with_one_value_for_most_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 7, 1.0).otherwise(F.col("id") / 30000).alias("p"))
    got = fdr.bh_adjust(df, "p").groupBy("p").agg(F.min("FDR").alias("lo"), F.max("FDR").alias("hi")).orderBy("p").collect()
    assert all(r.lo == r.hi for r in got) and got[-1].hi == 1.0


def panel(rng, n, sex="female", cell="a", start=0):
    out = []
    for i in range(n):
        x, z, u = map(float, rng.normal(size=3))
        y = 0.5 * x - 0.2 * z + float(rng.normal()) + (0.4 * x if sex == "male" else 0)
        out.append([cell, sex, f"d{start + i}", y, y * y, x, u, 3.0, z])
    return out


COLUMNS = "cell string, sex string, projid string, WP_Y double, `GOBP.Q` double, `p.x` double, pu double, pconst double, z double"


def least_squares(y, x, z, extra=()):
    scale = lambda v: (v - np.nanmean(v)) / np.nanstd(v, ddof=1)
    design = np.column_stack([np.ones(len(y)), scale(x), scale(z)])
    ok = ~np.isnan(design).any(axis=1) & ~np.isnan(y)
    design, y = design[ok], y[ok]
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    rss = ((y - design @ beta) ** 2).sum()
    cov = rss / (len(y) - 3) * np.linalg.inv(design.T @ design)
    return beta[1], math.sqrt(cov[1, 1])


def test_association(spark):
    rng = np.random.default_rng(0)
    data = panel(rng, 60) + panel(rng, 45, "male", start=100) + panel(rng, 29, cell="b", start=200)
    data[3][3] = None       # response missing: x still scales
    data[5][5] = None       # predictor missing
    data[7][8] = None       # covariate missing
    df = spark.createDataFrame([tuple(r) for r in data], COLUMNS)
    got = keyed(
        association.associate(df, ["cell", "sex"], ["WP_Y", "GOBP.Q"], ["p.x", "pu", "pconst"], "z", "projid"),
        "cell", "sex", "pathway", "predictor",
    )
    # 29 rows are too few, a constant predictor has no spread
    assert set(got) == {("a", s, r, p) for s in ("female", "male") for r in ("WP_Y", "GOBP.Q") for p in ("p.x", "pu")}
    for (cell, sex, response, predictor), r in got.items():
        own = np.array([[np.nan if v is None else v for v in row[3:]] for row in data if row[0] == cell and row[1] == sex], dtype=float)
        y, x, z = own[:, 0 if response == "WP_Y" else 1], own[:, 2 if predictor == "p.x" else 3], own[:, 5]
        b, se = least_squares(y, x, z)
        assert close(r.estimate, b, 1e-9) and close(r.std_error, se, 1e-9) and close(r.statistic, b / se, 1e-9)
        assert (r.n_obs, r.n_id, r.used_RE) == (len(own), len(own), False) and 0 < r.p_value < 1


def test_association_degenerate(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(40):
        x, z = float(rng.normal()), float(rng.normal())
        rows.append(("a", "f", f"d{i}", 1 + 2 * x, 1.0, x, None, 2 * x, z))
    df = spark.createDataFrame(rows, COLUMNS)
    got = keyed(association.associate(df, ["cell", "sex"], ["WP_Y"], ["p.x", "pu", "pconst"], "z", "projid"), "predictor")
    xs = np.array([r[5] for r in rows])
    assert close(got["p.x"].estimate, 2 * xs.std(ddof=1), 1e-9) and got["p.x"].std_error < 1e-6
    assert "pu" not in got
    # a covariate equal to the predictor leaves no coefficient
    same = df.withColumn("z", F.col("`p.x`") * 3)
    r = association.associate_ols(same, ["cell", "sex"], ["WP_Y"], ["p.x"], "z", "projid").first()
    assert r.estimate is None and r.std_error is None and r.p_value is None
    flat = df.withColumn("z", F.lit(1.0))
    assert association.associate_ols(flat, ["cell", "sex"], ["WP_Y"], ["p.x"], "z", "projid").first().estimate is None


def test_interaction(spark):
    rng = np.random.default_rng(4)
    data = panel(rng, 30) + panel(rng, 25, "male", start=100) + panel(rng, 12, cell="b", start=300)
    data[2][3] = None
    data[4][5] = float("inf")
    data[6][8] = None
    df = spark.createDataFrame([tuple(r) for r in data], COLUMNS)
    got = keyed(
        association.interact(df, ["cell"], "sex", ["female", "male"], ["WP_Y"], ["p.x", "pconst"], "z", "projid"),
        "cell", "predictor",
    )
    assert set(got) == set(itertools.product("ab", ["p.x", "pconst"]))
    for key in [("b", "p.x"), ("a", "pconst"), ("b", "pconst")]:
        assert got[key].estimate is None and got[key].p_value is None
    own = [r for r in data if r[0] == "a" and r[3] is not None and math.isfinite(r[5])]
    y, x = np.array([r[3] for r in own]), np.array([r[5] for r in own])
    z = np.array([np.nan if r[8] is None else r[8] for r in own])
    m = np.array([r[1] == "male" for r in own], dtype=float)
    xs, zs = (x - x.mean()) / x.std(ddof=1), (z - np.nanmean(z)) / np.nanstd(z, ddof=1)
    design = np.column_stack([np.ones(len(y)), m, xs, m * xs, zs])
    ok = ~np.isnan(zs)
    design, y = design[ok], y[ok]
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    rss = ((y - design @ beta) ** 2).sum()
    se = math.sqrt(rss / (len(y) - 5) * np.linalg.inv(design.T @ design)[3, 3])
    r = got[("a", "p.x")]
    assert close(r.estimate, beta[3], 1e-9) and close(r.std_error, se, 1e-9) and 0 < r.p_value < 1


def dense_random_intercept(y, design, ids):
    """Profile likelihood on the full covariance matrix, by a fine search."""
    same = (np.array(ids)[:, None] == np.array(ids)[None, :]).astype(float)
    n = len(y)

    def fit(theta):
        inv = np.linalg.inv(np.eye(n) + theta * same)
        a = np.linalg.inv(design.T @ inv @ design)
        beta = a @ design.T @ inv @ y
        rss = (y - design @ beta) @ inv @ (y - design @ beta)
        dev = np.linalg.slogdet(np.eye(n) + theta * same)[1] + n * math.log(rss / n)
        return dev, beta, np.sqrt(np.diag(a) * rss / n)

    grid = np.concatenate([[0.0], np.exp(np.linspace(-8, 6, 300))])
    best = min(grid, key=lambda t: fit(t)[0])
    step = best * 0.1 + 1e-6
    for _ in range(60):
        best = min((max(best - step, 0), best, best + step), key=lambda t: fit(t)[0])
        step *= 0.75
    return fit(best)


@pytest.mark.parametrize("spread", [1.0, 0.0])
def test_random_intercept(spark, spread):
    rng = np.random.default_rng(8)
    rows = []
    for donor in range(25):
        u = spread * float(rng.normal())
        for _ in range(int(rng.integers(1, 5))):
            x, z = map(float, rng.normal(size=2))
            rows.append(("a", "f", f"d{donor}", 10 + 0.6 * x + u + float(rng.normal()), 0.0, x, 0.0, 0.0, z))
    df = spark.createDataFrame(rows, COLUMNS)
    got = association.associate(df, ["cell", "sex"], ["WP_Y"], ["p.x"], "z", "projid").collect()
    assert len(got) == 1 and got[0].used_RE and got[0].n_id == 25 and got[0].n_obs == len(rows)
    y, x, z = (np.array([r[i] for r in rows]) for i in (3, 5, 8))
    sc = lambda v: (v - v.mean()) / v.std(ddof=1)
    _, beta, se = dense_random_intercept(y, np.column_stack([np.ones(len(y)), sc(x), sc(z)]), [r[2] for r in rows])
    assert close(got[0].estimate, beta[1], 1e-5) and close(got[0].std_error, se[1], 1e-5)


def test_random_intercept_interaction_only_where_repeated(spark):
    rng = np.random.default_rng(9)
    rows = []
    for donor in range(40):
        u = float(rng.normal())
        for sex in ("female", "male"):
            x, z = map(float, rng.normal(size=2))
            rows.append(("a", sex, f"d{donor}", 0.3 * x + u + float(rng.normal()), 0.0, x, 0.0, 0.0, z))
    rows += [tuple(r) for r in panel(rng, 20, cell="c", start=900) + panel(rng, 20, "male", cell="c", start=950)]
    df = spark.createDataFrame(rows, COLUMNS)
    args = (["cell"], "sex", ["female", "male"], ["WP_Y"], ["p.x"], "z", "projid")
    got = keyed(association.interact(df, *args), "cell")
    plain = keyed(association.interact_ols(df, *args), "cell")
    assert got["c"] == plain["c"] and got["a"].estimate != plain["a"].estimate
    own = [r for r in rows if r[0] == "a"]
    y, x, z = (np.array([r[i] for r in own]) for i in (3, 5, 8))
    m = np.array([r[1] == "male" for r in own], dtype=float)
    sc = lambda v: (v - v.mean()) / v.std(ddof=1)
    design = np.column_stack([np.ones(len(y)), m, sc(x), m * sc(x), sc(z)])
    _, beta, se = dense_random_intercept(y, design, [r[2] for r in own])
    assert close(got["a"].estimate, beta[3], 1e-4) and close(got["a"].std_error, se[3], 1e-4)
    assert close(got["a"].p_value, math.erfc(abs(beta[3] / se[3]) / math.sqrt(2)), 1e-3)


def quasi_demeaned(y, design, subject):
    """Maximum likelihood by least squares on rows with a part of their subject's mean taken off."""
    order = np.argsort(subject, kind="stable")
    y, design = y[order], design[order]
    _, first, n = np.unique(subject[order], return_index=True, return_counts=True)
    per_row = np.repeat(n, n)
    both = np.column_stack([design, y])
    means = np.repeat(np.add.reduceat(both, first) / n[:, None], n, axis=0)

    def fit(g):
        theta = np.exp(g)
        q = (both - means) + means / np.sqrt(1 + per_row * theta)[:, None]
        beta, *_ = np.linalg.lstsq(q[:, :-1], q[:, -1], rcond=None)
        rss = float(((q[:, -1] - q[:, :-1] @ beta) ** 2).sum())
        inverse = np.linalg.inv(q[:, :-1].T @ q[:, :-1])
        return np.log1p(n * theta).sum() + len(y) * np.log(rss), beta, np.sqrt(np.diag(inverse) * rss / len(y))

    best = min(np.arange(-26, 24, 0.5), key=lambda g: fit(g)[0])
    step = 0.5
    for _ in range(40):
        best = min((best - step, best, best + step), key=lambda g: fit(g)[0])
        step *= 0.6
    return fit(best)


@pytest.mark.parametrize("subjects, each, sd", [(5, 100_000, 100.0), (200, 3, 1000.0), (8, 50_000, 0.0)])
def test_random_intercept_of_large_subjects_and_spreads(spark, tmp_path, subjects, each, sd):
    rng = np.random.default_rng(subjects)
    n = subjects * each
    subject = np.repeat(np.arange(subjects), each)
    x, z = rng.normal(size=n) + subject % 3, rng.normal(size=n)
    y = 10 + 0.6 * x + sd * rng.normal(size=subjects)[subject] + rng.normal(size=n)
    pd.DataFrame({"cell": "a", "id": subject, "y": y, "x": x, "z": z}).to_parquet(f"{tmp_path}/t.parquet")
    df = spark.read.parquet(f"{tmp_path}/t.parquet")
    got = association.associate(df, ["cell"], ["y"], ["x"], "z", "id").collect()
    sc = lambda v: (v - v.mean()) / v.std(ddof=1)
    _, beta, se = quasi_demeaned(y - y.mean(), np.column_stack([np.ones(n), sc(x), sc(z)]), subject)
    assert close(got[0].estimate, beta[1], 1e-6) and close(got[0].std_error, se[1], 1e-5)


def test_mixed_models_without_a_fit_are_null_rows(spark):
    rows = [("a", "f", f"d{i % 20}", float(i % 7), 0.0, float(i), 0.0, 0.0, 5.0) for i in range(60)]
    got = association.associate(spark.createDataFrame(rows, COLUMNS), ["cell"], ["WP_Y"], ["p.x"], "z", "projid").collect()
    assert len(got) == 1 and got[0].used_RE and got[0].estimate is None


def test_unbounded_likelihood_gives_null():
    n, pairs = 6, [(i, j) for i in range(2) for j in range(i, 2)]
    # response constant within every subject: no within-subject error is left
    sizes = [{"__n": 2, "__m": n, "__ss": [4.0 * n, 0.0, 4.0 * 9.0], "__cc": [0.0, 0.0, 0.0]}]
    assert len(pairs) == 3
    est, se = mixed.fit_sizes(sizes, 2, 0)
    assert math.isnan(est) and math.isnan(se)


def test_group_contrast(spark):
    df = spark.createDataFrame(
        [("p", "female", 1.0), ("p", "female", 3.0), ("p", "male", 0.5), ("p", "male", 1.5), ("p", "male", None),
         ("q", "female", 2.0), ("r", "female", None), ("r", "male", 1.0)], "k string, sex string, v double")
    got = keyed(contrast.group_contrast(df, ["k"], "sex", "female", "male", "v"), "k")
    p = got["p"]
    assert (p.m_female, p.m_male, p.n_female, p.n_male, p.delta) == (2.0, 1.0, 2, 2, 1.0)
    assert close(p.se, math.sqrt(2 / 2 + 0.5 / 2)) and close(p.ci, 1.96 * p.se)
    assert got["q"].delta is None and got["q"].n_male is None and got["r"].n_female == 0 and got["r"].se is None


def test_standardise(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0), ("c", 2.0), ("c", 2.0)], "g string, v double")
    got = [(r.g, r.s) for r in association.standardise(df, "v", ["g"], "s").orderBy("g", F.asc_nulls_last("v")).collect()]
    assert close(got[0][1], -math.sqrt(0.5)) and got[2:] == [("a", None), ("b", None), ("c", None), ("c", None)]


def test_equal_tables_stay_apart(spark):
    df = spark.createDataFrame([(3, 7, 9, 2), (3, 7, 9, 2), (0, 0, 3, 4)], "a int, b int, c int, d int")
    got = fisher.fisher_2x2(df, "a", "b", "c", "d").collect()
    assert sorted(round(r.p, 9) for r in got) == [0.029973123, 0.029973123, 1.0]


def test_adjustment_routes_agree_on_many_distinct_values(spark):
    df = spark.range(30_000).select((F.xxhash64("id") % 1_000_003 / 1_000_003.0).alias("p"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("p", F.abs("p"))
    a = fdr._bh_window(df, "p", ["g"], "FDR").orderBy("g", "p").collect()
    b = fdr._bh_spread(df, "p", ["g"], "FDR").orderBy("g", "p").collect()
    assert len(a) == len(b) and all(x.p == y.p and close(x.FDR, y.FDR, 1e-12) for x, y in zip(a, b))


def test_adjustment_spreads_values_that_lie_close(spark):
    """All p within one part in 10^9 of each other: every range has its share, results as in one window."""
    df = spark.range(20_000).select((0.5 + F.col("id") * 2.0**-46).alias("p"), (F.col("id") % 2).alias("g"))
    a = fdr._bh_window(df, "p", ["g"], "FDR").orderBy("g", "p").collect()
    b = fdr._bh_spread(df, "p", ["g"], "FDR").orderBy("g", "p").collect()
    assert len(a) == len(b) == 20_000 and all(x.p == y.p and close(x.FDR, y.FDR, 1e-12) for x, y in zip(a, b))
    dealt = ranges.in_ranges(df, ["g", "p"], "r").groupBy("r").agg(F.count("*").alias("n"), F.min("p").alias("low")).collect()
    wanted = ranges.RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(dealt) == wanted and max(r.n for r in dealt) <= 2 * 20_000 / wanted


def _exact_two_sided(a, b, c, d):
    row1, row2, col1 = a + b, c + d, a + c
    low, high = max(0, col1 - row2), min(col1, row1)
    weights = [math.comb(row1, k) * math.comb(row2, col1 - k) for k in range(low, high + 1)]
    seen = weights[a - low]
    return float(Fraction(sum(w for w in weights if w * 10**7 <= seen * (10**7 + 1)), sum(weights)))


def test_fisher_against_whole_numbers():
    rng = random.Random(1)
    tables = [[rng.randint(0, m) for _ in range(4)] for m in (2, 10, 300) for _ in range(150)]
    tables += [[900, 1, 2, 800], [0, 900, 800, 0], [5, 1000, 1000, 5], [0, 0, 0, 0], [7, 0, 0, 0], [500, 500, 500, 500]]
    got = fisher.two_sided(*np.array(tables, float).T)
    np.testing.assert_allclose(got, [_exact_two_sided(*t) for t in tables], rtol=1e-11)


def test_fisher_with_margins_of_a_thousand_million():
    tables = np.array([[5e8] * 4, [5e8 + 20000, 5e8 - 20000, 5e8, 5e8], [500400000, 499600000, 499600000, 500400000], [1e9, 0, 0, 1e9]])
    same, some, far, beyond = fisher.two_sided(*tables.T)
    assert same == 1.0 and beyond == 0.0
    # the normal tail with continuity correction, as margins are large
    sd = math.sqrt(1e9 * 1e9 * (1e9 + 20000) * (1e9 - 20000) / (2e9**2 * (2e9 - 1)))
    assert some == pytest.approx(math.erfc((10000 - 0.5) / sd / math.sqrt(2)), rel=1e-4)
    assert 1e-300 < far < 1e-270


def test_fisher_keeps_rows(spark):
    rows = [("a", 3, 7, 9, 2), ("a", 3, 7, 9, 2), ("b", None, 1, 1, 1), (None, 0, 0, 3, 4)]
    df = spark.createDataFrame(rows, "k string, a int, b int, c int, d int")
    got = sorted((str(r["k"]), None if r["p"] is None else round(r["p"], 12)) for r in fisher.fisher_2x2(df, "a", "b", "c", "d").collect())
    assert got == [("None", 1.0), ("a", 0.029973122852), ("a", 0.029973122852), ("b", None)]
    plan = fisher.fisher_2x2(df, "a", "b", "c", "d")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_models_searched_together_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(5)

    def model(subjects, width=3):
        sizes = []
        for n in range(1, 1 + rng.integers(1, 6)):
            held = rng.normal(size=(subjects, n, width)) + rng.normal(size=(subjects, 1, width))
            s = held.sum(axis=1)
            inside = held - held.mean(axis=1, keepdims=True)
            at = np.triu_indices(width)
            sizes.append({"__n": n, "__m": subjects, "__ss": (s.T @ s)[at], "__cc": np.einsum("bni,bnj->ij", inside, inside)[at]})
        return sizes

    models = [model(int(rng.integers(2, 9))) for _ in range(40)]
    together = np.array(mixed.fit_models(models, 3, 1))
    alone = np.array([mixed.fit_sizes(m, 3, 1) for m in models]).T
    np.testing.assert_allclose(together, alone, rtol=1e-9)
    monkeypatch.setattr(mixed, "_HELD", 200)
    np.testing.assert_allclose(np.array(mixed.fit_models(models, 3, 1)), alone, rtol=1e-9)


def test_medians_of_bounded_groups_by_lists(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        ("a", 3.0, 1.0), ("a", 1.0, None), ("a", 2.0, 5.0), ("b", 4.0, nan), ("b", 7.0, None),
        ("c", inf, inf), ("c", inf, 2.0), ("d", -inf, 0.1), ("d", 2.0, 0.2), ("e", None, -1.0),
        (None, 6.0, 8.0), (None, 8.0, 8.0),
    ]
    df = spark.createDataFrame(rows, "k string, `x.1` double, y double")
    lists = quantiles.exact_medians(df, ["k"], ["x.1", "y"], max_group_rows=10)
    # by values counted one by one, every row of a group becomes a map entry that is sorted and sent
    assert "collect_list" in plan(lists) and "percentile" not in plan(lists)
    want = {"a": (2.0, 3.0), "b": (5.5, None), "c": (inf, inf), "d": (-inf, 0.1 * 0.5 + 0.2 * 0.5), "e": (None, -1.0), None: (7.0, 8.0)}
    assert {r[0]: (r[1], r[2]) for r in lists.collect()} == want
    built_in = quantiles.exact_medians(df, ["k"], ["x.1", "y"])
    assert {r[0]: (r[1], r[2]) for r in built_in.collect()} == want
