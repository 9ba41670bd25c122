import gzip

import pytest
from helpers import close, keyed, plan, rows
from pyspark.sql import functions as F

from effectgrid.operators import checks, drivers, filters, genesets, matrix, pseudobulk
from effectgrid.plans import scores as sc
from effectgrid.sources import tables
from effectgrid.study import Study


def test_stack_named(spark):
    a = spark.createDataFrame([("g", 1.0)], "gene string, logFC double")
    b = spark.createDataFrame([("h", "male")], "gene string, sex string")
    got = keyed(tables.stack_named({"A": a, "B": b}), "gene")
    assert got["g"].list_name == got["g"].idx == "A" and got["g"].sex is None and got["h"].logFC is None


def test_read_contrasts(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"gene": ["g"], "logFC": [float("nan")]}), tmp_path / "one.parquet")
    pq.write_table(pa.table({"gene": ["h"], "sex": ["male"]}), tmp_path / "two.parquet")
    got = keyed(tables.read_contrasts(spark, str(tmp_path)), "gene")
    assert (got["g"].list_name, got["g"].logFC, got["h"].idx, got["h"].sex) == ("one", None, "two", "male")


def test_read_contrasts_of_part_files(spark, tmp_path):
    frame = spark.createDataFrame([("g", 1.0), ("h", 2.0)], "gene string, logFC double")
    frame.repartition(2).write.parquet(str(tmp_path / "first.parquet"))
    frame.limit(1).write.parquet(str(tmp_path / "second"))
    for source in (str(tmp_path), [str(tmp_path / "first.parquet"), str(tmp_path / "second")]):
        got = tables.read_contrasts(spark, source).groupBy("list_name").count().collect()
        assert sorted(map(tuple, got)) == [("first", 2), ("second", 1)]


def test_rename_if_absent(spark):
    df = spark.createDataFrame([(1, 2)], "response int, n int")
    assert tables.rename_if_absent(df, "response", "pathway").columns == ["pathway", "n"]
    assert tables.rename_if_absent(df, "response", "n") is df
    with pytest.raises(ValueError):
        tables.rename_if_absent(df, "a", "b")


def test_gzip_csv(spark, tmp_path):
    path = str(tmp_path / "obs.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write("projid,major celltype-0,msex,2x,score\n7,Ast,1,4,0.5\n8,NA,0,5,NA\n9,Mic,NA,6,NaN\n")
    df = tables.read_wide_csv(spark, path)
    assert df.columns == ["projid", "major.celltype.0", "msex", "X2x", "score"]
    got = keyed(df, "projid")
    assert got[7].score == 0.5 and got[8].score is None and got[9].score is None and got[8]["major.celltype.0"] is None
    assert dict(df.dtypes)["projid"] == "int"


def test_wide_csv_to_bulk(spark, tmp_path):
    path = str(tmp_path / "obs.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write("projid,major.celltype.0,msex,WP_A,GOBP_B,other,pct_counts_mt,gpath\n")
        f.write("1,Ast,1,1,10,0,5,0.1\n1,Ast,1,3,NA,0,7,0.1\n1,Foo,1,9,9,0,9,0.1\n2,Mic,0,NA,1,0,1,0.2\n2,Mic,0,NA,2,0,2,NA\n")
    obs = tables.read_wide_csv(spark, path)
    study = Study()
    assert sc.score_columns(obs, study) == ["WP_A", "GOBP_B"]
    assert sc.phenotype_columns(obs, study)[0] == ["gpath"] and "nft" in sc.phenotype_columns(obs, study)[1]
    bulk = keyed(sc.pseudobulk_table(obs, study), "projid", "cell_major", "sex")
    assert (bulk[("1", "Ast", "male")].WP_A, bulk[("1", "Ast", "male")].GOBP_B, bulk[("1", "Ast", "male")].pct_counts_mt) == (2.0, 10.0, 6.0)
    assert bulk[("2", "Mic", "female")].WP_A is None and bulk[("1", None, "male")].WP_A == 9.0
    # donor 2 has two phenotype rows, so its bulk row fans out
    joined = sc.bulk_with_pheno(obs, study)
    assert joined.filter("projid = '2'").count() == 2 and joined.filter("projid = '1'").count() == 2
    assert checks.repeated_keys(sc.donor_pheno(obs, study), ["projid"]).first()[:] == (2, 1)


def test_first_available(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(ValueError):
        tables.first_available(spark, "no_such_table", str(tmp_path / "none"))
    assert tables.first_available(spark, "no_such_table", str(tmp_path / "none"), df).count() == 3
    spark.range(5).write.parquet(str(tmp_path / "t"))
    assert tables.first_available(spark, "no_such_table", str(tmp_path / "t"), df).count() == 5
    spark.range(7).createOrReplaceTempView("a_view")
    assert tables.first_available(spark, "a_view", str(tmp_path / "t"), df).count() == 7


def test_first_row_per(spark):
    df = spark.createDataFrame([("d", 2, 1.0), ("d", 1, None), ("e", 5, 3.0)], "projid string, o int, v double")
    got = keyed(pseudobulk.donor_first_rows(df, "projid", ["v"], "o"), "projid")
    assert got["d"].v is None and got["e"].v == 3.0


def test_gene_sets(spark):
    effects = spark.createDataFrame([("MT-1", 1), ("MT.2", 1), ("X", 1), ("Z", 1), ("XMT-1", 1), (None, 1)], "gene string, v int")
    annot = spark.createDataFrame([("T1", "X"), ("T1", "Q"), ("T2", "X"), ("T3", "Z"), ("T1", None)], "goall string, symbol string")
    terms, prefix = ["T1", "T2"], r"^MT[-\.]"
    assert sorted(r.symbol for r in genesets.gene_set(effects, annot, terms, prefix).collect()) == ["MT-1", "MT.2", "X"]
    assert sorted(r.gene for r in genesets.keep_gene_set(effects, annot, terms, prefix).collect()) == ["MT-1", "MT.2", "X"]
    assert genesets.gene_set_sizes(effects, annot, terms, prefix).first()[:] == (2, 2, 4, 3)
    by_sets = genesets.observed_set(
        genesets.combined_set(genesets.annotated(annot, terms), genesets.with_prefix(effects, prefix)), effects)
    assert sorted(r.symbol for r in by_sets.collect()) == ["MT-1", "MT.2", "X"]
    kept = filters.in_set(effects, genesets.gene_set(effects, annot, terms, prefix), "gene")
    assert kept.count() == 3


def test_closure_with_shared_children_and_cycle(spark):
    edges = spark.createDataFrame(
        [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("b", "e"), ("y", "x")], "child string, parent string")
    roots = spark.createDataFrame([("a",), ("d",)], "term string")
    got = {(r.root, r.term) for r in genesets.descendants(edges, roots).collect()}
    assert got == {("a", t) for t in "abcde"} | {("d", t) for t in "debd"}
    direct = spark.createDataFrame([("e", "g1"), ("e", "g1"), ("y", "g2"), ("a", "g3"), ("a", None)], "term string, symbol string")
    members = {(r.root, r.symbol) for r in genesets.members_with_descendants(edges, roots, direct).collect()}
    assert members == {("a", "g1"), ("a", "g3"), ("d", "g1")}


def test_matrix_rules(spark):
    df = spark.createDataFrame(
        [("g1", "c1", 5.0), ("g1", "c2", -5.0), ("g2", "c1", 0.0), ("g2", "c2", 1.0), ("g3", "c1", 1.0), ("g3", "c2", 2.0),
         ("g4", "c1", None), ("g5", "c1", 1.0), ("g5", "c2", 1.5)], "g string, c string, v double")
    got = keyed(matrix.variance_top_matrix(df, "g", "c", "v", n=2, cap=2.0), "g", "c")
    # zero is missing, so g2 has one value and no variance; g5 varies least
    assert {k: r.v for k, r in got.items()} == {("g1", "c1"): 2.0, ("g1", "c2"): -2.0, ("g3", "c1"): 1.0, ("g3", "c2"): 2.0}


def test_pairwise_distance(spark):
    import numpy as np

    values = {"a": [1, 2, 3, 5, None, None], "b": [2, 1, 4, 4, 1, None], "c": [7, 7, 7, 7, 7, None], "d": [None, None, None, 3, None, 1],
              "e": [None] * 5 + [4], "f": [-1, -2, -3, -5, None, None]}
    df = spark.createDataFrame([(k, str(i), None if v is None else float(v)) for k, vs in values.items() for i, v in enumerate(vs)],
                               "i string, d string, v double")
    dist = matrix.pairwise_distance(df, "i", "d", "v")
    got = {(r.a, r.b): r.dist for r in dist.collect()}
    assert len(got) == 15 and all(0 <= v <= 2 for v in got.values())
    assert close(got[("a", "b")], 1 - np.corrcoef([1, 2, 3, 5], [2, 1, 4, 4])[0, 1]) and close(got[("a", "f")], 2.0)
    for pair in [("a", "c"), ("b", "c"), ("a", "d"), ("a", "e"), ("d", "e"), ("c", "d")]:
        assert got[pair] == 1.0
    text = plan(dist)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def leading_inputs(spark):
    scores = spark.createDataFrame(
        [("Ast", "female", "WP_A", p, s) for p, s in [("p1", 2.0), ("p2", -1.0), ("p3", 0.0), ("p4", None), ("p5", 1.0)]]
        + [("Ast", "male", "WP_B", p, 1.0) for p in ("q1", "q2", "q3")],
        "cell_major string, sex string, pathway string, predictor string, stat double")
    effects = spark.createDataFrame(
        [("Ast", "female", "p1", "g1", 0.5), ("Ast", "female", "p1", "g1", -0.5), ("Ast", "female", "p2", "g1", -0.1),
         ("Ast", "female", "p3", "g1", 0.3), ("Ast", "female", "p4", "g1", 0.3), ("Ast", "female", "p5", "g1", None),
         ("Ast", "female", "p1", "g2", 0.1), ("Ast", "female", "p3", "g2", 0.0), ("Ast", "female", "p5", "g2", 2.0),
         ("Ast", "female", "p1", "g3", 0.1), ("Mic", "female", "p1", "g4", 0.1)],
        "cell_major string, sex string, path_short string, gene string, logFC double")
    return scores, effects


def test_sign_drivers(spark):
    scores, effects = leading_inputs(spark)
    top = scores.select("cell_major", "sex", "pathway").distinct()
    got = keyed(drivers.sign_drivers(top, scores, effects, min_n=1), "pathway", "gene")
    assert close(got[("WP_A", "g1")].agree, 2 / 4) and got[("WP_A", "g1")].n == 6
    assert (got[("WP_A", "g2")].agree, got[("WP_A", "g2")].n) == (1.0, 3) and got[("WP_A", "g3")].n == 1
    # no effects for the male panel: one null-gene group that counts its rows
    assert (got[("WP_B", None)].agree, got[("WP_B", None)].n) == (None, 3)
    kept = drivers.sign_drivers(top, scores, effects, min_n=3, n=1)
    assert {(r.pathway, r.gene) for r in kept.collect()} == {("WP_A", "g2"), ("WP_B", None)}


def test_hot_panel_is_dealt_by_gene(spark, monkeypatch):
    """A panel with nine tenths of the rows: same result in parts, and no task far above the median."""
    genes = spark.range(20_000).select(
        F.when(F.col("id") < 18_000, "Ast").otherwise("Mic").alias("cell_major"), F.lit("female").alias("sex"),
        F.lit("p1").alias("path_short"), F.concat(F.lit("g"), "id").alias("gene"), (F.col("id") % 3 - 1.0).alias("logFC"))
    scores = spark.createDataFrame(
        [(c, "female", w, "p1", 1.0) for c in ("Ast", "Mic") for w in ("A", "B")],
        "cell_major string, sex string, pathway string, predictor string, stat double")
    top = scores.select("cell_major", "sex", "pathway")
    whole = sorted(map(str, drivers.sign_agreement(top, scores, genes).collect()))
    monkeypatch.setattr(drivers, "PART_GENES", 100)
    assert sorted(map(str, drivers.sign_agreement(top, scores, genes).collect())) == whole and len(whole) == 40_000
    signs = genes.withColumnRenamed("path_short", "predictor")
    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(key, value)
    try:
        wanted = scores.select("cell_major", "sex", "predictor", "pathway")
        tasks = drivers._dealt(signs, wanted, 180).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    counts = sorted(r["count"] for r in tasks)
    assert len(counts) == 4 and counts[-1] <= 2 * counts[len(counts) // 2]


def test_top_items_distinct_or_not(spark):
    strong = spark.createDataFrame(
        [("Ast", "male", w, p, m) for w, m in [("A", 9.0), ("B", 8.0), ("C", 7.0)] for p in ("p1", "p2")],
        "cell_major string, sex string, pathway string, predictor string, max_abs double")
    assert sorted(r.pathway for r in drivers.top_items(strong, 2).collect()) == ["A", "B"]
    assert sorted(r.pathway for r in drivers.top_items(strong, 3, distinct_items=False).collect()) == ["A", "A", "B"]


def test_lookup(spark):
    lead = spark.createDataFrame(
        [("Oli", "male", "GOBP_MITOPHAGY_X", f"g{i}", i / 10, 4) for i in range(5)] + [("Oli", "female", "WP_TCA", "h", None, 3)],
        "cell_major string, sex string, pathway string, gene string, agree double, n long")
    got = rows(drivers.drivers_for(lead, "Oli", "mitophagy", n=2))
    assert sorted(r["gene"] for r in got) == ["g3", "g4"] and got[0]["path_clean"] == "MITOPHAGY X"
    assert drivers.drivers_for(lead, "Oli", "mitophagy", ignore_case=False).count() == 0
    assert drivers.drivers_for(lead, "Oli", "^GOBP_MITOPHAGY_X$").count() == 0
    assert [r.path_clean for r in drivers.driver_examples(lead, "Oli").collect()] == ["MITOPHAGY X", "TCA"]
    with pytest.raises(ValueError):
        drivers.drivers_for(lead.drop("agree"), "Oli", "x")
    focus = drivers.drivers_focus(lead, "(MITOPHAGY|FUSION)", n=3)
    assert sorted(r.gene for r in focus.collect()) == ["g2", "g3", "g4"]


def test_checks(spark):
    df = spark.createDataFrame([("NA",), (None,), ("x",)], "g string")
    assert checks.bad_names(df, "g").first()[:] == (1, 1) and checks.row_count(df).first().n_rows == 3
    with pytest.raises(ValueError):
        checks.require_any([])


def test_signed_scores_forms_agree(spark):
    res = spark.createDataFrame(
        [("Ast", "male", "p", "A", -2.0, 0.01), ("Ast", "male", "p", "B", 1.0, 1.0), ("Ast", "male", "p", "C", None, None)],
        "cell_major string, sex string, predictor string, pathway string, beta double, FDR double")
    a = {r.pathway: r.stat for r in sc.signed_scores(res).collect()}
    b = {r.pathway: r.stat for r in sc.signed_scores_grouped(res).collect()}
    assert a == b and close(a["A"], -2.0) and a["B"] == 0.0 and a["C"] is None


def test_missing_p_uses_normal_tail(spark):
    import math

    fits = spark.createDataFrame(
        [("Ast", "male", "A", "p", 2.0, 1.0, None, None), ("Ast", "male", "B", "p", 1.0, 1.0, 1.0, 0.4)],
        "cell_major string, sex string, pathway string, predictor string, estimate double, std_error double, statistic double, p_value double")
    got = {r.pathway: r for r in sc.adjusted(fits, 2).collect()}
    assert close(got["A"].p, math.erfc(2 / math.sqrt(2)), 1e-10) and got["B"].p == 0.4 and close(got["A"].FDR, 2 * got["A"].p)


def test_closure_of_a_thousand_levels_takes_a_dozen_rounds(spark, monkeypatch):
    chain = [(f"t{i + 1}", f"t{i}") for i in range(1000)] + [("t0", "t1000"), ("t5", "t5"), (None, "t3"), ("t7", None)]
    edges = spark.createDataFrame(chain, "child string, parent string")
    roots = spark.createDataFrame([("t0",), ("alone",)], "term string")
    calls = []
    own = genesets.checkpointed
    monkeypatch.setattr(genesets, "checkpointed", lambda df: calls.append(1) or own(df))
    got = {(r.root, r.term) for r in genesets.descendants(edges, roots).collect()}
    assert got == {("t0", f"t{i}") for i in range(1001)} | {("alone", "alone")}
    assert (len(calls) - 2 + 2) // 3 <= 12  # up to three tables a round


def test_file_order_is_the_stored_order(spark, tmp_path):
    folder = str(tmp_path / "rows")
    rows = [("a", 3.0), ("b", 1.0), ("a", 1.0), ("a", 2.0), ("b", 0.0)]
    spark.createDataFrame(rows, "projid string, x double").coalesce(1).write.parquet(folder)
    spark.createDataFrame([("a", 9.0), ("c", 5.0)], "projid string, x double").coalesce(1).write.parquet(folder + "2")
    for parts in (1, 7):
        table = tables.read_in_order(spark, folder).repartition(parts)
        assert sorted(map(tuple, pseudobulk.donor_first_rows(table, "projid", ["x"], "file_order").collect())) == [("a", 3.0), ("b", 1.0)]
    both = tables.read_in_order(spark, folder + "2").unionByName(tables.read_in_order(spark, folder))
    got = {r.projid: r.x for r in pseudobulk.donor_first_rows(both, "projid", ["x"], "file_order").collect()}
    assert got == {"a": 3.0, "b": 1.0, "c": 5.0}  # "rows/" sorts before "rows2/"


def test_distances_by_tiles_and_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(8)
    values = rng.normal(size=(23, 40)) * 10.0 ** rng.integers(-3, 4, size=(23, 1)) + 1e4
    values[rng.random(values.shape) < 0.4] = np.nan
    values[3] = 7.1  # constant
    values[4, :] = np.nan
    values[4, 2] = 1.0
    values[5, :20], values[6, 20:] = np.nan, np.nan  # nothing shared
    cells = [(f"i{i}", f"d{d}", float(v)) for i, row in enumerate(values) for d, v in enumerate(row) if not np.isnan(v)]
    expected = {}
    for i in range(23):
        for j in range(23):
            if f"i{i}" < f"i{j}":
                both = ~np.isnan(values[i]) & ~np.isnan(values[j])
                x, y = values[i][both], values[j][both]
                fine = both.sum() > 1 and np.ptp(x) > 0 and np.ptp(y) > 0
                expected[f"i{i}", f"i{j}"] = 1 - np.clip(np.corrcoef(x, y)[0, 1], -1, 1) if fine else 1.0
    df = spark.createDataFrame([*cells, ("i1", None, 1.0), (None, "d1", 1.0), ("i2", "d3", None)], "i string, d string, v double")
    df = df.dropDuplicates()
    for tile, block in ((256, 1024), (5, 1024), (4, 7)):
        monkeypatch.setattr(matrix, "TILE_ITEMS", tile)
        monkeypatch.setattr(matrix, "BLOCK_DIMS", block)
        got = {(r.a, r.b): r.dist for r in matrix.pairwise_distance(df, "i", "d", "v").collect()}
        assert got.keys() == expected.keys()
        assert all(abs(got[k] - expected[k]) < 1e-8 for k in got)
    assert matrix.pairwise_distance(df.limit(0), "i", "d", "v").collect() == []
