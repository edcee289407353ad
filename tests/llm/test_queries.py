"""The llm queries that SQL can express, against DuckDB on the same tables."""

import os
from collections import Counter

import duckdb
import pytest

from pagegrain.llm import queries
from tests.test_queries import plain


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    df = queries.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    rows = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in rows.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rows.fetchall())
