"""Queries with SQL give its rows on the smallest tables; the others run over them."""

import math

import pytest

import __spark_entry__ as entry
from reviewloom.llm import oracle_sql, queries

from .conftest import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="benchmark tables are not here")
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(float(value) + 0.0) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = queries()[name](spark, str(DATA))
    result = connection.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


def test_all_are_registered():
    assert {int(name[2:].split("_")[0]) for name in queries()} == set(range(1, 14))
    assert set(queries()) | {"pipeline"} <= set(entry.queries())
