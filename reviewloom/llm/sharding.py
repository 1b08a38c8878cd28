"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in built-in expressions.

A key and the number of shards decide the shard, without a ring table. With one
more shard, rows move only into the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.llm.common import body, keep, ranges, table

LOW = 0xFFFFFFFF
# Multiplier of the generator of the published method, as two 32-bit halves
FACTOR_HIGH, FACTOR_LOW = divmod(2862933555777941757, 1 << 32)
FEW_JUMPS = 64


def _low_product(a: Column, b: int) -> tuple[Column, Column]:
    """(high, low) 32-bit halves of ``a * b`` for unsigned 32-bit numbers, free of overflow."""
    upper = a * F.lit(b >> 16)  # below 2^48
    lower = a * F.lit(b & 0xFFFF) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16)  # below 2^50
    return F.shiftright(upper, 16) + F.shiftright(lower, 32), lower.bitwiseAND(F.lit(LOW))


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """The 64-bit key times the factor plus one, modulo 2^64, as halves."""
    carry, product = _low_product(low, FACTOR_LOW)
    cross = _low_product(low, FACTOR_HIGH)[1] + _low_product(high, FACTOR_LOW)[1]
    bottom = product + 1
    top = (carry + cross + F.shiftright(bottom, 32)).bitwiseAND(F.lit(LOW))
    return top, bottom.bitwiseAND(F.lit(LOW))


def _jumps(key: Column, shards: int, steps: int) -> Column:
    """(shard, target): the last jump below ``shards`` after at most ``steps`` jumps, and the next one."""
    state = F.struct(
        F.shiftright(key, 32).bitwiseAND(F.lit(LOW)).alias("high"),
        key.bitwiseAND(F.lit(LOW)).alias("low"),
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("target"),
    )

    def jump(at: Column, _: Column) -> Column:
        high, low = _next(at["high"], at["low"])
        share = F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double")
        moved = F.struct(
            high.alias("high"),
            low.alias("low"),
            at["target"].alias("shard"),
            F.floor((at["target"] + 1).cast("double") * share).cast("long").alias("target"),
        )
        return F.when(at["target"] >= shards, at).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, jump)


def jump_state(key: Column, shards: int) -> Column:
    """Struct with ``shard`` (0..shards-1) and ``target``, the shard count at which the key next moves.

    A NULL key counts as 0. Each step strictly raises the shard, so ``shards`` steps
    always end; few are needed, and the long way is taken only by keys not done by then.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    few = min(shards, FEW_JUMPS)
    state = _jumps(key, shards, few)
    if few < shards:
        state = F.when(state["target"] >= shards, state).otherwise(_jumps(key, shards, shards))
    return state


def text_key(column: Column) -> Column:
    """Stable 64-bit key of any column, for keys that are not whole numbers."""
    return F.xxhash64(column)


def shard_rows(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None
) -> DataFrame:
    """Each row's shard and its place there: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``slot`` counts 0, 1, ... in each shard by (id, size, checksum), NULL ids first;
    equal rows take neighbouring slots. A NULL text has size 1 and checksum 0.
    An empty table gives no rows. Other columns of the input are not read.

    Only the narrow rows move. They are put into ranges over all three columns and a
    row number, so that a key with many rows is cut too, and numbered by range.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = body(text_col)
    narrow = keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            jump_state(F.col(id_col) if key is None else key, shards).alias("state"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    order = ["doc_id", "size", "text_crc32", "row"]
    parts = ranges(docs.sparkSession, narrow.count())
    placed = keep(
        narrow.repartitionByRange(parts, *order).select(
            "doc_id",
            "size",
            "text_crc32",
            F.col("state.shard").cast("int").alias("shard"),
            F.when(F.col("state.target") == shards, shards).otherwise(F.col("state.shard")).cast("int").alias("grown_shard"),
            "row",
            F.spark_partition_id().alias("part"),
        )
    )
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = F.row_number().over(W.partitionBy("shard", "part").orderBy(*order))
    return placed.join(starts, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + inside - 1).alias("slot"),
        "grown_shard",
    )


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), 8)


CRC_SQL = """CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
  string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g'), ''),
  lambda c: CAST(instr('0123456789ABCDEF', c) - 1 AS BIGINT))),
  lambda acc, n: xor(acc >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
    3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]
    [CAST(xor(acc, n) & 15 AS INTEGER) + 1]))) AS BIGINT)"""

ORACLE = f"""
WITH RECURSIVE jumps(doc_id, key, shard, target) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM documents
  UNION ALL
  SELECT doc_id, next, target, CAST(floor(CAST(target + 1 AS DOUBLE)
           * (2147483648.0::DOUBLE / CAST((next // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jumps WHERE target < 8)
), ends AS (SELECT doc_id, shard, target FROM jumps WHERE target >= 8),
sized AS (
  SELECT d.doc_id, strlen(coalesce(text, '')) + 1 AS size,
         CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {CRC_SQL} END AS text_crc32,
         shard, target
  FROM documents d JOIN ends e ON d.doc_id IS NOT DISTINCT FROM e.doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       CAST(CASE WHEN target = 8 THEN 8 ELSE shard END AS INTEGER) AS grown_shard
FROM sized
"""
