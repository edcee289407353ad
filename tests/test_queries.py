"""Every layout query against its SQL, run by DuckDB on the same tables."""

import os
from collections import Counter

import duckdb
import pytest

from pagegrain import queries as layout


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(layout.ORACLES))
def test_query_matches_its_sql(spark, duck, sf, name):
    df = layout.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    rows = duck.execute(layout.ORACLES[name])
    columns = [d[0] for d in rows.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rows.fetchall())


def test_recorded_answers_have_a_row_for_each_document(spark, sf):
    rows = layout.QUERIES["recorded_answers"](spark, sf).collect()
    assert rows and all(r.model == "echo" and r.prompt_tokens > 0 for r in rows)


def test_recorded_answers_ask_about_every_document_with_text(spark, sf):
    ids = [r.doc_id for r in layout.QUERIES["recorded_answers"](spark, sf).select("doc_id").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("trim(text) <> ''")
    assert sorted(ids) == sorted(r.doc_id for r in docs.select("doc_id").collect())
