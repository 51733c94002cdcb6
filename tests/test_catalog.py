"""Every registered query of the similarity engine against its SQL in DuckDB, over the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from popsieve.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    wanted = duck.execute(catalog.SQL[name])
    columns = sorted(c[0] for c in wanted.description)
    assert sorted(found.columns) == columns
    places = [[c[0] for c in wanted.description].index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in found.collect()) == Counter(tuple(r[k] for k in places) for r in wanted.fetchall())
