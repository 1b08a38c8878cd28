"""Equal-width histograms as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_BIN = 180
SEGMENT_BINS = 34


def histogram(df: DataFrame, column: str, bins: int | None = None, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """(bin, bin_low, bin_high, n) over the range of the values, the last bin closed.

    Without ``bins`` there is one bin for every ``rows_per_bin`` rows, at least
    one. NULL values count as rows but fall in no bin. If all values are equal the
    range is widened by one half on both sides. The range is found by a first job.
    """
    value = F.col(column).cast("double")
    data = df.select(F.when(~F.isnan(value), value).alias("v"))
    rows, low, high = data.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if bins is None:
        bins = max(1, rows // rows_per_bin)
    if low is None:
        bins, low, high = 0, 0.0, 0.0
    elif low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / max(1, bins)
    index = F.least(F.floor((F.col("v") - low) / F.lit(width)), F.lit(bins - 1)).cast("long")
    counts = data.filter(F.col("v").isNotNull()).groupBy(index.alias("bin")).agg(F.count("v").alias("n"))

    def edge(number: Column) -> Column:
        return F.lit(low) + F.lit(high - low) * number / F.lit(bins)

    numbers = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return numbers.join(counts, "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("bin_low"),
        edge(F.col("bin") + 1).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def segmented_histogram(series: dict[str, DataFrame], column: str, bins: int = SEGMENT_BINS) -> DataFrame:
    """Histograms of several series, each over its own range, told apart by ``series``."""
    parts = [histogram(df, column, bins).select(F.lit(name).alias("series"), "*") for name, df in series.items()]
    return reduce(DataFrame.unionByName, parts)
