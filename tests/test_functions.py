import math

import numpy as np
import pytest
from helpers import close, keyed, rows
from pyspark.sql import functions as F

from effectgrid.functions import labels, scalars, special

LEVELS = ["Ast", "Exc", "Inh", "Mic", "Oli", "OPC", "Vas", "T_cells"]


def test_cell_labels(spark):
    df = spark.createDataFrame(
        [("InN",), ("InN.A",), ("InN_A",), ("T.cells",), ("Foo",), ("Ast.GRM3",), ("InNer",), (None,)], "c string"
    ).withColumn("m", labels.major_cell(labels.normalise_cell(F.col("c")), LEVELS))
    got = {r["c"]: r["m"] for r in rows(df)}
    assert got == {
        "InN": "Inh", "InN.A": "Inh", "InN_A": "Inh", "T.cells": "T_cells",
        "Foo": "Foo", "Ast.GRM3": "Ast", "InNer": "InNer", None: None,
    }


def test_closed_level_and_ordinal(spark):
    df = spark.createDataFrame([("Vas",), ("Foo",), (None,)], "c string").select(
        "c", labels.closed_level(F.col("c"), LEVELS).alias("f"), labels.level_ordinal(F.col("c"), LEVELS).alias("o")
    )
    assert [(r.f, r.o) for r in df.collect()] == [("Vas", 7), (None, None), (None, None)]


def test_pathway_label_and_truncate(spark):
    long = "GOBP_" + "A" * 61
    df = spark.createDataFrame([("GOCC_A_B",), ("GOBP_A_B",), ("KEGG_A",), (long,), ("WP_" + "B" * 60,)], "p string")
    got = [r.l for r in df.select(labels.pathway_label(F.col("p"), 60).alias("l")).collect()]
    assert got == ["GOCC A B", "A B", "KEGG A", "A" * 57 + "...", "B" * 60]


def test_keys(spark):
    df = spark.createDataFrame([("Ast", "male"), (None, "female")], "c string, s string")
    df = df.withColumn("k", labels.join_key(F.col("c"), F.col("s")))
    got = df.select("k", labels.key_head(F.col("k")).alias("h"), labels.key_tail(F.col("k")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("Ast|male", "Ast", "male"), ("NA|female", "NA", "female")]


def test_binary_sex_and_suffix(spark):
    df = spark.createDataFrame([(1, "a.scaled"), (0, "a.scaled.b"), (None, "scaled")], "m int, p string")
    got = df.select(labels.binary_sex(F.col("m")).alias("s"), labels.strip_suffix(F.col("p")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("male", "a"), ("female", "a.scaled.b"), (None, "scaled")]


def test_winsorise_and_scores(spark):
    df = spark.createDataFrame([(None, None), (5.0, 0.0), (-5.0, 1.0), (1.0, 0.01)], "x double, p double")
    got = df.select(
        scalars.winsorise(F.col("x"), 2.0).alias("w"), scalars.signed_log10(F.col("x"), F.col("p")).alias("s")
    ).collect()
    assert [r.w for r in got] == [None, 2.0, -2.0, 1.0]
    assert got[0].s is None and close(got[1].s, 300.0) and got[2].s == 0.0 and close(got[3].s, 2.0)
    assert math.copysign(1, got[2].s) == 1


def test_direction_and_remainder(spark):
    df = spark.createDataFrame([(0.1, 5, 7), (0.0, 5, 2), (None, None, 1)], "e double, t long, p long")
    got = df.select(
        scalars.direction(F.col("e")).alias("d"), scalars.remainder(F.col("t"), F.col("p")).alias("r")
    ).collect()
    assert [tuple(r) for r in got] == [("up", 0), ("down", 3), (None, None)]


def test_value_bucket_is_monotone(spark):
    rng = np.random.default_rng(5)
    values = sorted(
        [0.0, -0.0, 1e-310, -1e-310, 1e300, -1e300, 1.0, -1.0]
        + list(rng.normal(size=500)) + list(rng.lognormal(0, 8, size=500)) + list(-rng.lognormal(0, 8, size=200))
    )
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select(
        "v", scalars.value_bucket(F.col("v")).alias("b")
    )
    got = sorted((r.v, r.b) for r in df.collect())
    buckets = [b for _, b in got]
    assert buckets == sorted(buckets)
    assert len(set(buckets)) > 900


@pytest.mark.parametrize(
    "t,df,p,rel",
    [  # published critical values, to the digits they are printed with
        (2.776445, 4, 0.05, 1e-5), (2.042272, 30, 0.05, 1e-5), (12.7062, 1, 0.05, 1e-5), (3.390, 100, 0.001, 2e-3),
    ],
)
def test_t_table(spark, t, df, p, rel):
    got = spark.createDataFrame([(t, df)], "t double, d int").select(special.t_two_sided("t", "d").alias("p")).first().p
    assert close(got, p, rel)


def test_t_against_integration(spark):
    cases = [(0.0, 7), (0.3, 3), (1.0, 147), (2.5, 12), (8.0, 40), (15.0, 250), (6.0, 1), (-2.0, 9), (40.0, 100)]
    got = spark.createDataFrame([(float(t), d) for t, d in cases], "t double, d int").select(
        "t", "d", special.t_two_sided("t", "d").alias("p")
    ).collect()
    for r in got:
        # p = 2 * integral of the density over s = t/(u) substitution, u in (0, 1]
        t, nu = abs(r.t), r.d
        ln_c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
        if t == 0:
            assert r.p == 1.0
            continue
        g, w = np.polynomial.legendre.leggauss(400)
        v = (g + 1) / 2 * math.atan(math.sqrt(nu) / t)  # x = sqrt(nu) / tan(v)
        density = np.exp(ln_c + 0.5 * math.log(nu) + (nu - 1) * np.log(np.sin(v)))
        expected = 2 * float((w * density).sum()) / 2 * math.atan(math.sqrt(nu) / t)
        assert close(r.p, expected, 1e-9), (r, expected)


def test_t_null_and_bad_df(spark):
    df = spark.createDataFrame([(None, 5), (1.0, 0), (1.0, -2)], "t double, d int")
    assert [r.p for r in df.select(special.t_two_sided("t", "d").alias("p")).collect()] == [None, None, None]


def test_normal_tail(spark):
    zs = [0.0, 0.01, 0.5, 1.0, 1.999, 2.0, 2.001, 3.0, 6.0, 12.0, 30.0, -1.5]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", special.normal_two_sided("z").alias("p"))
    for r in df.collect():
        assert close(r.p, math.erfc(abs(r.z) / math.sqrt(2)), 1e-11), r


def test_ln_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 1e5, 1e9]
    got = keyed(spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.ln_gamma("x").alias("g")), "x")
    for x in xs:
        assert close(got[x].g, math.lgamma(x), 1e-12, 1e-12)
