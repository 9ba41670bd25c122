import numpy as np
from helpers import close, keyed, plan, rows
from pyspark.sql import functions as F

from effectgrid.operators import counts, filters, grid, quantiles, ranges, topn
from effectgrid.plans import effects as fx
from effectgrid.study import Study

NAN = float("nan")


def test_significant_edges(spark):
    df = spark.createDataFrame(
        [("nan_fc", NAN, 0.01), ("nan_p", 1.0, NAN), ("at_alpha", 1.0, 0.05), ("at_min", -0.2, 0.049),
         ("below", 0.19, 0.01), ("null_fc", None, 0.01), ("null_p", 1.0, None), ("ok", 0.9, 0.0)],
        "k string, logFC double, adj_p double",
    )
    assert sorted(r.k for r in filters.significant(df).collect()) == ["at_min", "ok"]


def test_grid_levels_observed_and_null(spark):
    df = spark.createDataFrame([("a", "p", 2), ("b", "q", 3)], "c string, p string, n long")
    got = keyed(grid.complete_grid(df, {"c": ["a", "b", "z"], "p": None}, {"n": 0}), "c", "p")
    assert len(got) == 6 and sum(r.n for r in got.values()) == 5 and got[("z", "q")].n == 0
    with_null = df.union(spark.createDataFrame([(None, "p", 7)], "c string, p string, n long"))
    got = keyed(grid.complete_grid(with_null, {"c": ["a", "b", "z"], "p": None}, {"n": 0}), "c", "p")
    assert len(got) == 8 and got[(None, "p")].n == 7 and got[(None, "q")].n == 0


def test_grid_median_stays_null_and_single_sex(spark):
    df = spark.createDataFrame([("a", "female", 2, 0.5)], "c string, s string, n long, m double")
    got = keyed(grid.complete_grid(df, {"c": ["a", "b"], "s": None}, {"n": 0}), "c", "s")
    assert set(got) == {("a", "female"), ("b", "female")} and got[("b", "female")].m is None


def test_grid_by_group(spark):
    df = spark.createDataFrame([("x", "a", "f", 1), ("y", "b", "m", 2)], "g string, c string, s string, n long")
    got = keyed(grid.complete_grid(df, {"c": ["a", "b"], "s": None}, {"n": 0}, by=["g"]), "g", "c", "s")
    assert set(got) == {("x", "a", "f"), ("x", "b", "f"), ("y", "a", "m"), ("y", "b", "m")}


def test_distinct_counts_overall(spark):
    df = spark.createDataFrame(
        [("p", "a", "g1"), ("p", "a", "g2"), ("q", "a", "g1"), ("q", None, "g1")], "path string, c string, gene string"
    )
    got = keyed(counts.distinct_counts(df, ["path", "c"], overall="path"), "path", "c")
    assert {k: r.n_sig for k, r in got.items()} == {
        ("p", "a"): 2, ("q", "a"): 1, ("q", None): 1, ("(all)", "a"): 2, ("(all)", None): 1,
    }


def test_counts_with_median(spark):
    df = spark.createDataFrame(
        [("a", "g1", 0.3), ("a", "g1", 0.5), ("a", "g2", None), ("b", "g9", None)], "c string, gene string, logFC double"
    )
    got = keyed(counts.counts_with_median(df, ["c"]), "c")
    assert (got["a"].n_sig, got["a"].med_lfc) == (2, 0.4) and (got["b"].n_sig, got["b"].med_lfc) == (1, None)


def test_direction_and_recurrence(spark):
    df = spark.createDataFrame(
        [("a", "p", "g1", 0.3), ("a", "p", "g1", -0.3), ("a", "q", "g1", 0.4), ("a", "p", "g2", -0.4)],
        "cell_major string, path_short string, gene string, logFC double",
    )
    got = keyed(counts.direction_ratio(df, ["cell_major", "path_short"]), "path_short")
    assert (got["p"].up, got["p"].down) == (1, 2) and close(got["p"].log2_up_down, np.log2(1.5 / 2.5))
    rec = keyed(counts.recurrence(df, ["cell_major", "gene"]), "gene")
    assert (rec["g1"].n_path, rec["g1"].pos, rec["g1"].neg) == (2, 2, 1)


def test_box_stats(spark):
    df = spark.createDataFrame([("a", v) for v in [1, 2, 3, 4, 100]], "c string, n long")
    r = counts.box_stats(df, ["c"], "n").first()
    assert (r.lower, r.q1, r.median, r.q3, r.upper, r.n) == (1.0, 2.0, 3.0, 4.0, 4.0, 5)


def test_most_frequent_and_crosstab(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    assert [tuple(r) for r in counts.most_frequent(df, ["k"], 1).collect()] == [("a", 2)]
    got = keyed(counts.cross_table(df, "k", F.col("v") >= 2), "k")
    assert (got["a"].n_true, got["a"].n_false) == (1, 1)


def test_exact_quantiles_both_ways(spark):
    rng = np.random.default_rng(11)
    data = [("hot", float(v)) for v in rng.normal(size=3001)]
    data += [("dup", 0.0)] * 1500 + [("dup", float(v)) for v in rng.lognormal(size=800)]
    data += [("neg", float(-v)) for v in rng.lognormal(size=1200)]
    data += [("even", 1.0), ("even", 2.0), ("one", -3.0), ("none", None), ("none", None), ("nan", NAN), ("nan", 4.0)]
    data += [(None, 1.0), (None, 5.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    probs = {"q1": 0.25, "med": 0.5, "q9": 0.9}
    expected = {}
    for k, v in data:
        expected.setdefault(k, [])
        if v is not None and v == v:
            expected[k].append(v)
    # every group by the built-in; the large ones split; every group split
    for hot_rows in (10_000, 1000, 0):
        got = keyed(quantiles.exact_quantiles(df, ["k"], "v", probs, hot_rows=hot_rows), "k")
        assert set(got) == set(expected)
        for k, values in expected.items():
            for name, p in probs.items():
                want = float(np.quantile(values, p)) if values else None
                assert close(got[k][name], want, 1e-12), (hot_rows, k, name)


def test_medians_of_many_columns_hot_and_cold(spark, monkeypatch):
    rng = np.random.default_rng(2)
    names = [f"s.{i}" for i in range(10)]
    data = [(k, *map(float, rng.normal(size=10))) for k in ["a"] * 400 + ["b"] * 7]
    df = spark.createDataFrame(data, ["k", *names])
    array = np.array([r[1:] for r in data])
    keys = np.array([r[0] for r in data])
    monkeypatch.setattr(quantiles, "BLOCK_COLUMNS", 4)
    got = keyed(quantiles.exact_medians(df, ["k"], names, hot_rows=100), "k")
    for k in "ab":
        assert np.allclose([got[k][n] for n in names], np.median(array[keys == k], axis=0))


def test_profile(spark):
    df = spark.createDataFrame([(1.0, 10), (2.0, None), (NAN, 30), (4.0, 40)], "a double, b int")
    got = keyed(quantiles.profile(df, ["a", "b"]), "column")
    a = got["a"]
    assert (a.n, a.n_missing, a.min, a.q1, a["median"], a.q3, a["max"]) == (3, 1, 1.0, 1.5, 2.0, 3.0, 4.0)
    assert got["b"].n_missing == 1 and got["b"].q1 == 20.0


def test_top_n_order_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", "z", 1.0), ("a", "b", 1.0), ("a", "n", None), ("a", "c", 0.5)], "g string, k string, m double")
    order = [F.desc_nulls_last("m"), F.asc("k")]
    top = topn.top_n_per_group(df, ["g"], order, 3)
    assert [r.k for r in top.orderBy(*order).collect()] == ["b", "z", "c"]
    assert "n" in {r.k for r in topn.top_n_per_group(df, ["g"], order, 4).collect()}
    assert "WindowGroupLimit" in plan(top)


def test_top_n_by_limits(spark):
    df = spark.createDataFrame([(g, i) for g in "abc" for i in range(5)], "g string, v int")
    got = topn.top_n_by_limits(df, "g", [F.asc("v")], {"a": 2, "b": 4})
    assert sorted((r.g, r.v) for r in got.collect()) == [("a", 0), ("a", 1)] + [("b", i) for i in range(4)]
    assert "WindowGroupLimit" in plan(got)


def test_top_n_or_fallback(spark):
    df = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 0.5), ("b", "z", 0.4)], "g string, k string, m double")
    order = [F.desc_nulls_last("m"), F.asc("k")]

    def keep(threshold):
        return sorted(r.k for r in topn.top_n_or_fallback(df, ["g"], "m", order, 25, threshold).collect())

    assert keep(1.2) == ["x"] and keep(9.0) == ["x", "y", "z"]


def test_orders(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 6), ("c", 9)], "k string, n long")
    got = {r.k: r.o for r in grid.level_order(df, "k", "n", "o").collect()}
    assert got == {"c": 1, "a": 2, "b": 3}
    panels = spark.createDataFrame([("p", "a", 2.0), ("p", "b", 1.0), ("q", "a", 0.0)], "p string, l string, v double")
    got = keyed(grid.panel_order(panels, ["p"], "l", "v", "o"), "p", "l")
    assert {k: r.o for k, r in got.items()} == {("p", "b"): 1, ("p", "a"): 2, ("q", "a"): 1}


def test_invariants_on_tables(spark, sf_small):
    from effectgrid.plans.registry import _sig
    from effectgrid.study import TABLES_STUDY

    sig = _sig(spark, sf_small)
    by_sex = keyed(fx.sig_by_cell_sex(sig, TABLES_STUDY), "path_short", "cell_major", "sex")
    for (path, cell, sex), r in by_sex.items():
        if path == "(all)":
            parts = [q.n_sig for (p, c, s), q in by_sex.items() if p != "(all)" and (c, s) == (cell, sex)]
            assert max(parts, default=0) <= r.n_sig <= sum(parts)
    cells = fx.sig_by_cell_path(sig, TABLES_STUDY)
    n_path = sig.select("path_short").distinct().count()
    assert cells.count() == len(TABLES_STUDY.cell_levels) * n_path


def test_filters_reach_the_scan(spark, tmp_path):
    effects = spark.createDataFrame(
        [("MT-1", "Ast.1", "gpath.scaled", "Female", 0.5, 0.01), ("X", "InN", "nft", "male", -0.5, 0.01)],
        "gene string, celltype string, pathology string, sex string, logFC double, adj_p double",
    )
    effects.write.partitionBy("pathology").parquet(str(tmp_path / "e"))
    annot = spark.createDataFrame([("GO:0005739", "X"), ("GO:1", "Y")], "goall string, symbol string")
    sig = fx.significant_rows(spark.read.parquet(str(tmp_path / "e")), annot, Study())
    text = plan(sig)
    assert "LessThan(adj_p,0.05)" in text and "GreaterThanOrEqual(logFC,0.2)" in text
    assert "PartitionFilters: [pathology" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    got = rows(sig.select("gene", "cell_major", "path_short", "sex").orderBy("gene"))
    assert [tuple(r.values()) for r in got] == [("MT-1", "Ast", "gpath", "female"), ("X", "Inh", "nft", "male")]


def test_routes_agree_on_infinity_and_one_octave(spark):
    inf = float("inf")
    rng = np.random.default_rng(5)
    data = [("inf", v) for v in (inf, -inf, 1.0, 2.0, -0.0, 0.0, 5e-324, -5e-324, NAN, None)]
    data += [("up", v) for v in (inf, inf, inf, 1.0)] + [("one", inf), ("both", -inf), ("both", -inf), ("both", 3.0)]
    data += [("octave", float(v)) for v in 1 + rng.random(20_000)] + [(None, inf), (None, 2.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(4)
    probs = {"low": 0.1, "q1": 0.25, "med": 0.5, "q3": 0.75, "top": 1.0}
    routes = [keyed(quantiles.exact_quantiles(df, ["k"], "v", probs, hot_rows=h), "k") for h in (10**9, 0)]
    for k in routes[0]:
        for name in probs:
            a, b = routes[0][k][name], routes[1][k][name]
            assert (a is None and b is None) or a == b or close(a, b, 1e-14) or (a != a and b != b), (k, name, a, b)
    assert routes[1]["up"].med == inf and routes[1]["one"].med == inf and routes[1]["inf"].top == inf
    assert {k: r.med for k, r in routes[1].items()}["both"] == -inf


def test_profile_with_infinity_scans_twice(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0), (float("inf"), None), (3.0, NAN)], "a double, b double").write.parquet(f"{tmp_path}/t")
    df = quantiles.profile(spark.read.parquet(f"{tmp_path}/t"), ["a", "b"])
    got = keyed(df, "column")
    assert (got["a"].n, got["a"].min, got["a"].median, got["a"].max) == (3, 1.0, 3.0, float("inf"))
    assert (got["b"].n, got["b"].n_missing, got["b"].mean, got["b"].q1) == (1, 2, 2.0, 2.0)


def test_final_sort_sees_a_small_part_of_a_bucket(spark, monkeypatch):
    """One bucket of values, all but one of them close together: the sorted ranges stay even."""
    dealt = []
    monkeypatch.setattr(quantiles, "in_ranges", lambda *a: dealt.append(ranges.in_ranges(*a)) or dealt[-1])
    values = spark.range(50_000).select(
        F.lit("k").alias("key"),
        F.when(F.col("id") == 49_999, 1.0006).otherwise(1 + F.col("id") * 2.0**-50).alias("v"),
    )
    q = quantiles._by_buckets(values, ["key"], {"m": ("v", 0.5), "top": ("v", 1.0)}).first()
    assert q.m == 1 + 24_999.5 * 2.0**-50 and q.top == 1.0006
    sizes = [r["count"] for r in dealt[0].groupBy("__b", "__part").count().collect()]
    assert sum(sizes) == 50_000 and max(sizes) <= 2 * 50_000 / (ranges.RANGES * 4)


def test_no_second_route_without_hot_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, v double")
    assert "Union" not in plan(quantiles.exact_quantiles(df, ["k"], "v", {"m": 0.5}))


def test_grid_of_a_million_labels(spark):
    df = spark.range(1_000_000).select(
        F.col("id").cast("string").alias("c"), F.when(F.col("id") % 2 == 0, "f").otherwise("m").alias("s"), F.lit(3).cast("bigint").alias("n")
    )
    full = grid.complete_grid(df, {"c": None, "s": None}, {"n": 0})
    assert "collect_set" not in plan(full)
    assert tuple(full.agg(F.count("*"), F.sum("n"), F.count_if(F.col("n") == 0)).first()) == (2_000_000, 3_000_000, 1_000_000)
    empty = df.limit(0)
    assert grid.complete_grid(empty, {"c": None, "s": None}, {"n": 0}).count() == 0
    assert grid.complete_grid(empty, {"c": ["x"], "s": ["f", "m"]}, {"n": 0}).count() == 2


def test_groups_of_null_items_stay(spark):
    df = spark.createDataFrame([("x", None, 1.0), ("y", "g", 2.0)], "k string, gene string, logFC double")
    assert keyed(counts.distinct_counts(df, ["k"]), "k")["x"].n_sig == 0
    got = keyed(counts.counts_with_median(df, ["k"]), "k")
    assert (got["x"].n_sig, got["x"].med_lfc, got["y"].n_sig) == (0, 1.0, 1)
    got = keyed(counts.direction_ratio(df, ["k"]), "k")
    assert (got["x"].up, got["x"].down, got["x"].log2_up_down, got["y"].up) == (0, 0, 0.0, 1)
