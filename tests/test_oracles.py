"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import os

import pytest

from sheaf.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    return int(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    ours = df.collect()
    result = duck.sql(catalogue.ORACLE_SQL[name])
    theirs = result.fetchall()
    assert sorted(df.columns) == sorted(result.columns)
    assert ours, "vacuous"
    assert rows(df.columns, ours) == rows(result.columns, theirs)


def test_all_have_oracles():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
