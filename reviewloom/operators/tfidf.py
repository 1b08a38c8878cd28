"""TF-IDF as a long table (doc, term, weight)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.functions.text import ngrams, terms
from reviewloom.operators.lookup import BROADCAST_BYTES, lookup_join, measured_bytes
from reviewloom.operators.ranking import global_rank
from reviewloom.operators.rows import explode_rows
from reviewloom.session import ensure_checkpoint_dir, grown_partitions

MAX_DF = 0.9
MIN_DF = 1000
DOCS_PER_TASK = 5_000


def term_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "lemmatized_text",
    ngram: int = 1,
    n_docs: int | None = None,
) -> DataFrame:
    """(id, term, tf). Texts are placed by id once; counting their terms then needs no further shuffle.

    Partitions grow in number with the documents (``n_docs``, counted where not given), so
    that the counts one task holds at a time do not grow.
    """
    tasks = grown_partitions(docs.sparkSession, docs.count() if n_docs is None else n_docs, DOCS_PER_TASK)
    placed = docs.select(id_col, text_col).repartition(tasks, id_col)
    words = placed.select(id_col, terms(F.col(text_col)).alias("words"))
    return (
        explode_rows(words, ngrams(F.col("words"), ngram), "term", id_col)
        .groupBy(id_col, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def term_stats(counts: DataFrame) -> DataFrame:
    """(term, df, total): documents holding the term and its occurrences overall."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def prune(
    stats: DataFrame, n_docs: int, min_df: int | float, max_df: int | float, max_features: int | None = None
) -> DataFrame:
    """Terms inside the document-frequency limits, both inclusive.

    A whole number is a count of documents, a fraction a share of all of them.
    ``max_features`` keeps the most frequent terms, ties by term.
    """

    def limit(value: int | float) -> Column:
        return F.lit(value if isinstance(value, int) else value * n_docs)

    kept = stats.filter((F.col("df") >= limit(min_df)) & (F.col("df") <= limit(max_df)))
    if max_features is not None:
        kept = kept.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    return kept


def with_index(stats: DataFrame) -> DataFrame:
    """Adds ``term_idx``, the position of the term in alphabetical order."""
    return global_rank(stats, [F.col("term")], "term_idx")


def idf(df: Column, n_docs: int, kind: str = "smooth") -> Column:
    """``smooth``: ln((1+n)/(1+df)) + 1; ``plain``: ln(n/df)."""
    if kind == "smooth":
        return F.ln(F.lit(n_docs + 1) / (df + 1)) + 1
    if kind == "plain":
        return F.ln(F.lit(n_docs) / df)
    raise ValueError(f"unknown idf: {kind}")


@dataclass(frozen=True)
class Tfidf:
    """Weights (id, term, term_idx, tf, tfidf) and vocabulary (term, term_idx, df, total, idf)."""

    matrix: DataFrame
    vocabulary: DataFrame
    counts: DataFrame
    id_col: str

    def unpersist(self) -> None:
        self.counts.unpersist()


def tfidf(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "lemmatized_text",
    min_df: int | float = MIN_DF,
    max_df: int | float = MAX_DF,
    max_features: int | None = None,
    idf_kind: str = "smooth",
    normalize: bool = True,
    ngram: int = 1,
) -> Tfidf:
    """Weigh the terms of every document.

    The counts are kept for the three passes over them and are placed by id, so
    joining the vocabulary (broadcast when it is measured to be small) and
    scaling each document to length one happen where the rows are.
    """
    level = StorageLevel.MEMORY_AND_DISK
    ensure_checkpoint_dir(docs.sparkSession)
    n_docs = docs.count()
    counts = term_counts(docs, id_col, text_col, ngram, n_docs).persist(level)
    kept = prune(term_stats(counts), n_docs, min_df, max_df, max_features).persist(level)
    vocabulary = with_index(kept).withColumn("idf", idf(F.col("df"), n_docs, idf_kind)).checkpoint()
    kept.unpersist()
    size = measured_bytes(vocabulary)
    weighted = lookup_join(
        counts,
        vocabulary.select("term", "term_idx", "idf"),
        "term",
        table_bytes=size,
        key_rows=vocabulary.select("term", F.col("df").alias("n")),
    ).withColumn("tfidf", F.col("tf") * F.col("idf"))
    if normalize:
        if size > BROADCAST_BYTES:  # the lookup has moved the counts; no task gets more of them than before
            weighted = weighted.repartition(grown_partitions(docs.sparkSession, n_docs, DOCS_PER_TASK), id_col)
        length = F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf")).over(W.partitionBy(id_col)))
        weighted = weighted.withColumn("tfidf", F.try_divide("tfidf", length))
    return Tfidf(weighted.select(id_col, "term", "term_idx", "tf", "tfidf"), vocabulary, counts, id_col)
