"""Join of a large table with a lookup table holding one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.session import grown_partitions

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 1000


def measured_bytes(df: DataFrame, per_row: int = 64) -> int:
    """Size of a table from its row count and the length of its strings."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    size = F.lit(per_row)
    for name in strings:
        size = size + F.coalesce(F.octet_length(name), F.lit(0))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    table_bytes: int | None = None,
    key_rows: DataFrame | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``facts`` joined with ``table`` on ``key`` without moving hot keys.

    A table measured to fit ``max_bytes`` is broadcast and ``facts`` stay where
    they are. A larger one is split: keys that hold more than one in ``HOT_SHARE``
    rows, of which there are fewer than ``HOT_SHARE``, are broadcast, and the rest
    is shuffled, where no key is large any more. ``key_rows`` may give the known
    rows per key as (key, n). ``how`` is ``inner`` or ``left``.
    """
    if table_bytes is None:
        table_bytes = measured_bytes(table)
    if table_bytes <= max_bytes:
        return facts.join(F.broadcast(table), key, how)

    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if key_rows is None else key_rows
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot_keys = counts.filter((F.col("n") * HOT_SHARE > total) & F.col(key).isNotNull()).select(key)
    hot_table = F.broadcast(table.join(F.broadcast(hot_keys), key, "left_semi"))
    marked = facts.join(F.broadcast(hot_keys.withColumn("_hot", F.lit(True))), key, "left")
    hot = marked.filter(F.col("_hot")).drop("_hot").join(hot_table, key, how)
    cold = marked.filter(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot")
    cold = cold.repartition(grown_partitions(facts.sparkSession, total), key).join(table, key, how)
    joined = hot.unionByName(cold)
    if how == "left":  # rows without a key match nothing and need no shuffle
        bare = facts.filter(F.col(key).isNull())
        extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != key]
        joined = joined.unionByName(bare.select("*", *extra))
    return joined
