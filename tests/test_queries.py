"""Every registered query against its SQL on the test tables."""

import duckdb
import pytest

from effectgrid.plans.oracle import ORACLES
from effectgrid.plans.registry import QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings"]
# the panels of the smallest tables have too few donors for a model
SCORES = {
    "assoc", "assoc_fdr", "signed_score", "pathway_keyword", "top_pathways", "focus_pathways", "strength_crosstab",
    "sex_contrast", "interaction_top", "interaction_top_fallback", "drivers", "drivers_as_written", "drivers_report",
    "drivers_focus", "drivers_for", "driver_examples",
}
EMPTY = {"drivers_for_none", "matrix_names"}  # that nothing is found is what they show


def databases(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = [tuple(r[i] + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(flat, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_small, sf_mid, name):
    folder = sf_mid if name in SCORES else sf_small
    df = QUERIES[name](spark, folder)
    result = databases(folder).execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    expected = table(columns, result.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == expected
    assert expected or name in EMPTY or name not in SCORES


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, sf_mid, name):
    rows = QUERIES[name](spark, sf_mid).collect()
    assert rows and all(r.estimate is not None for r in rows)


def test_revised_donors_have_two_rows(spark, sf_small):
    assert QUERIES["donor_check_revised"](spark, sf_small).first().n_repeated > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
