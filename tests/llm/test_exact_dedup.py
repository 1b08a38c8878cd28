import hashlib

import pytest
from pyspark.sql import functions as F

from reviewloom.llm.exact_dedup import drop_copies, mark_copies, sha256

ROWS = [(1, "a"), (2, "b"), (3, "a"), (3, "a"), (4, None), (5, ""), (None, "b"), (None, "c"), (None, "c"), (9, "x" * 300_000)]


def short(text):
    return F.substring(sha256(text), 1, 1)  # so that different texts meet


def weakest(text):
    return F.lit("same")


@pytest.mark.parametrize("digest", [sha256, short, weakest])
def test_groups(spark, docs_of, tmp_path, digest):
    docs_of(ROWS).repartition(3).write.parquet(str(tmp_path / "d"))
    found = mark_copies(spark.read.parquet(str(tmp_path / "d")), digest=digest).collect()
    assert len(found) == len(ROWS)
    groups = {}
    for i, text in ROWS:
        groups.setdefault(text or "", []).append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in found) == len(groups)


def test_drop_copies_keeps_columns(spark, docs_of, tmp_path):
    docs_of(ROWS).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    empty = docs.filter("false")
    empty.write.parquet(str(tmp_path / "e"))
    assert drop_copies(spark.read.parquet(str(tmp_path / "e"))).count() == 0


def test_large_groups_are_looked_up_apart(spark, docs_of, tmp_path):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(6000)]
    docs_of(rows).repartition(5).write.parquet(str(tmp_path / "d"))
    found = mark_copies(spark.read.parquet(str(tmp_path / "d")))
    hot = found.filter("group_size > 1").agg(F.count("*"), F.sum(F.col("kept").cast("int")), F.max("keep_id")).first()
    assert tuple(hot) == (4000, 1, 5999) and found.filter("kept").count() == 2001
