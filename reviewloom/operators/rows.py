"""One row per element of a costly array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """Columns ``keep`` and one row per array element, which must not be NULL.

    A plain ``explode`` makes Spark add a filter on the size of the array and push
    it to the scan, where the array is then computed a second time.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """Like ``explode_rows``, with the place of the element as ``position``."""
    return df.select(*keep, F.posexplode_outer(array).alias("position", name)).filter(F.col(name).isNotNull())
