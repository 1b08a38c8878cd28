"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from reviewloom.workload import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(float(value) + 0.0)
    return str(value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


def test_every_query_has_sql_but_those_that_settle():
    assert set(queries()) - set(oracle_sql()) == {"topic_sweep", "polarity_topics"}
    assert set(oracle_sql()) <= set(queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, str(DATA))
    result = duck.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


def test_entry_gives_topics(spark):
    df = entry.entry(spark)
    assert df.columns == ["topic", "n_docs", "words"] and df.count() == 4


def test_topic_sweep_covers_1_to_30(monkeypatch):
    from importlib import import_module
    from types import SimpleNamespace

    q = import_module("reviewloom.workload.queries")

    monkeypatch.setattr(q, "_weights", lambda *_: SimpleNamespace(matrix=None, vocabulary=None))
    monkeypatch.setattr(q.rl, "topic_sweep", lambda matrix, vocabulary, counts, settings: list(counts))
    assert q.topic_sweep(None, "") == list(range(1, 31))
