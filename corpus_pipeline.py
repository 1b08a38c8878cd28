"""From raw documents to packed sequences: quality, toxicity, exact and near copies, packing.

Each stage reads what its predecessor kept, written as Parquet to the folder that
``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from reviewloom.llm.exact_dedup import drop_copies
from reviewloom.llm.minhash_dedup import drop_near_copies
from reviewloom.llm.packing import pack_documents
from reviewloom.llm.quality import drop_poor
from reviewloom.llm.toxicity import drop_toxic


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely good than poor, by their text and their site."""
    return drop_poor(docs, _labels(spark, sf_dir))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely harmless than toxic."""
    return drop_toxic(docs, _labels(spark, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("packing", packing),
]

ORACLE_SQL = None  # classifiers, sketches and byte-pair merges have no SQL; tests/llm checks them


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = f"{folder}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
