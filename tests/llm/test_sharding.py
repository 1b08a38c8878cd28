import random
from collections import Counter

from pyspark.sql import functions as F

from reviewloom.llm.sharding import jump_state, shard_rows


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_as_published(spark):
    draw = random.Random(1)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(draw.randrange(-(2**63), 2**63) for _ in range(300))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 8, 9, 1000):
        found = df.select("k", jump_state(F.col("k"), shards)["shard"].alias("s")).collect()
        assert [r.s for r in found] == [jump(r.k, shards) for r in found]


def test_the_long_way_gives_the_same(spark, monkeypatch):
    from reviewloom.llm import sharding

    monkeypatch.setattr(sharding, "FEW_JUMPS", 2)
    found = spark.range(200).select("id", sharding.jump_state(F.col("id"), 50)["shard"].alias("s")).collect()
    assert [r.s for r in found] == [jump(r.id, 50) for r in found]


def test_rows_of_all_kinds(spark, docs_of):
    rows = [(None, None), (None, "a"), (5, ""), (5, ""), (5, "é"), *((i, "x" * i) for i in range(100)), (7, "y" * 200_000)]
    found = shard_rows(docs_of(rows), 8).collect()
    assert len(found) == len(rows)
    for shard, n in Counter(r.shard for r in found).items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    assert all(r.grown_shard in (r.shard, 8) and r.grown_shard == jump(r.doc_id or 0, 9) for r in found)
    assert {(r.size, r.text_crc32) for r in found if r.doc_id is None} == {(1, 0), (2, 3904355907)}
    assert shard_rows(docs_of([]), 8).count() == 0
