"""Parquet tables and JSON document collections."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.schemas import REVIEWS, WORK_LIST


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_spread(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Table for work that is heavy per row.

    A scan with fewer splits than the session has cores, such as a single large
    row group, is dealt out by ``key``. A scan with enough splits stays as it is.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the table at ``path``; it must not be one that ``df`` still reads."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to the collection at ``path``."""
    df.write.mode("append").parquet(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All documents of a JSON collection; keys outside the schema are dropped, missing ones NULL."""
    return spark.read.schema(schema).json(path)


def project_reviews(documents: DataFrame) -> DataFrame:
    """The review columns of a document collection, absent ones filled with NULL."""
    return documents.select(
        *[
            (F.col(f.name) if f.name in documents.columns else F.lit(None)).try_cast(f.dataType).alias(f.name)
            for f in REVIEWS
        ]
    )


def _read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_shards(spark: SparkSession, paths: Iterable[str], optional: Iterable[str] = ()) -> DataFrame:
    """Union of the shard tables; an optional shard takes part only if it exists."""
    shards = [spark.read.parquet(path) for path in paths]
    shards += [df for path in optional if (df := _read_if_there(spark, path)) is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def write_work_list(work: DataFrame, path: str) -> None:
    write_table(work.select(*WORK_LIST.fieldNames()), path)


def read_work_list(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, WORK_LIST)
