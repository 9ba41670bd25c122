"""The queries against their SQL on the given tables, all rows."""

import duckdb
import pytest

from effectgrid.llm.oracle import ORACLES
from effectgrid.llm.queries import QUERIES

TABLES = ["documents", "pages", "benchmark", "labels"]


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def agree(df, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    expected = table(columns, result.fetchall())
    assert expected and table(df.columns, [tuple(r) for r in df.collect()]) == expected


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_mid, name):
    agree(QUERIES[name](spark, sf_mid), ORACLES[name], sf_mid)
