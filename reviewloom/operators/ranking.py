"""Global order and exact quantiles without a global sort task.

Rows are cut into ranges, numbered inside their range, and shifted by the sizes of
the ranges before. The functions run small jobs over their input, and keep what they
read more than once.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.session import ensure_checkpoint_dir

BUCKETS = 128
ROWS_PER_RANGE = 1_000_000
SMALL_ROWS = 100_000
_ACCURACY = 10_000


def cut_points(df: DataFrame, code: Column, buckets: int = BUCKETS) -> list[float]:
    """At most ``buckets - 1`` increasing values cutting the rows into ranges of similar size."""
    shares = [i / buckets for i in range(1, buckets)]
    found = df.select(code.cast("double").alias("c")).agg(F.percentile_approx("c", shares, _ACCURACY)).first()[0]
    return sorted(set(found or []))


def _range_of(code: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points not above the code; -1 for NULL."""
    if not cuts:
        return F.when(code.isNull(), F.lit(-1)).otherwise(F.lit(0))
    below = F.size(F.filter(F.lit(list(cuts)), lambda cut: cut <= F.col("_code")))
    return F.when(code.isNull(), F.lit(-1)).otherwise(below)


def _tag_ranges(df: DataFrame, code: Column, cuts: Sequence[float]) -> DataFrame:
    coded = df.withColumn("_code", code.cast("double"))
    return coded.withColumn("_range", _range_of(F.col("_code"), cuts)).drop("_code")


def _sizes(tagged: DataFrame, size: Column, first: int, ranges: int) -> list[int]:
    """Size of each range; there are as many as were asked for, whatever the data."""
    found = dict(tagged.groupBy("_range").agg(size.alias("n")).collect())
    return [found.get(i, 0) for i in range(first, first + ranges)]


def _start(sizes: Sequence[int], first: int) -> Column:
    starts = [0, *accumulate(sizes)][:-1]
    return F.get(F.lit(starts).cast("array<bigint>"), F.col("_range") - first)


def global_rank(df: DataFrame, order_by: Sequence[Column], out: str, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Position 0..n-1 in the order ``order_by``, NULLs where that order puts them.

    Rows are kept once, cut into ranges over all of the order (Spark samples the cut
    points), numbered inside their range, and shifted by the sizes of the ranges before.
    Ranges grow in number with the rows. Equal rows may share a range however many they
    are; add a column to the order that tells them apart.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint()
    ranges = max(1, -(-kept.count() // per_range))
    placed = kept.repartitionByRange(ranges, *order_by).withColumn("_range", F.spark_partition_id()).checkpoint()
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order_by))
    ranked = placed.join(starts, "_range").withColumn("_inside", inside)
    return ranked.select(*df.columns, (F.col("_start") + F.col("_inside") - 1).alias(out))


def with_row_id(df: DataFrame, out: str = "doc_id", per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Row number 0..n-1 of distinct rows, stable for the same set of rows.

    The order is that of a 128-bit hash of the row, which also tells which columns are
    NULL. Only the hash is ranked; the rows then find their number by it, so no text goes
    through a window.
    """
    nulls = [F.col(name).isNull() for name in df.columns]  # a hash passes over NULLs
    keys = {"_key": F.xxhash64(*nulls, *df.columns), "_key2": F.xxhash64(F.lit(1), *nulls, *df.columns)}
    hashed = df.withColumns(keys)
    ranked = global_rank(hashed.select(*keys), [F.col(key) for key in keys], out, per_range)
    return hashed.join(ranked, list(keys)).select(out, *df.columns)


def exact_quantiles(
    df: DataFrame, column: str, quantiles: Sequence[float], buckets: int = BUCKETS, small: int = SMALL_ROWS
) -> list[float | None]:
    """Exact quantiles with linear interpolation, NULL and NaN skipped; None without values.

    Equal values are counted before anything is shuffled. Up to ``small`` different
    values are enough to read the quantiles off; ratings have a few dozen. With
    more, only the ranges that hold a wanted position are sorted.
    """
    counts = (
        df.select(F.col(column).cast("double").alias("v"))
        .filter(F.col("v").isNotNull() & ~F.isnan("v"))
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("n"))
        .persist()
    )
    try:
        return _quantiles_of_counts(counts, quantiles, buckets, small)
    finally:
        counts.unpersist()


def _quantiles_of_counts(
    counts: DataFrame, quantiles: Sequence[float], buckets: int, small: int
) -> list[float | None]:
    few = counts.limit(small + 1).coalesce(1).collect()
    if len(few) <= small:
        few.sort()
        ends = list(accumulate(n for _, n in few))
        total = ends[-1] if ends else 0
    else:
        cuts = cut_points(counts, F.col("v"), buckets)
        tagged = _tag_ranges(counts, F.col("v"), cuts)
        sizes = _sizes(tagged, F.sum("n"), 0, len(cuts) + 1)
        ends = list(accumulate(sizes))
        total = ends[-1]
    if total == 0:
        return [None] * len(quantiles)

    spots = [(total - 1) * q for q in quantiles]
    wanted = sorted({position for spot in spots for position in (math.floor(spot), math.ceil(spot))})
    groups = [bisect_right(ends, position) for position in wanted]
    if len(few) <= small:
        at = {position: few[group][0] for position, group in zip(wanted, groups)}
    else:  # at most two ranges per quantile are left, and one value per wanted position is fetched
        last = _start(sizes, 0) + F.sum("n").over(W.partitionBy("_range").orderBy("v"))
        ranked = tagged.filter(F.col("_range").isin(*groups)).withColumn("_last", last)
        holds = [(F.col("_last") - F.col("n") <= p) & (F.col("_last") > p) for p in wanted]
        at = dict(zip(wanted, ranked.agg(*[F.max(F.when(hold, F.col("v"))) for hold in holds]).first()))
    return [at[math.floor(s)] + (at[math.ceil(s)] - at[math.floor(s)]) * (s - math.floor(s)) for s in spots]
