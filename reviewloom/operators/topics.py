"""Reports on a fitted factorisation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.functions.vectors import cross_moments, vector_sum
from reviewloom.operators.lookup import BROADCAST_BYTES
from reviewloom.operators.nmf import NMFModel, NMFSettings, nmf_fit, place_by_document
from reviewloom.operators.nmf_sweep import fit_side_by_side

LABEL_SHARE = 0.20
SUMMARY_WORDS = 20
CLOUD_WORDS = 150


def topic_terms(h: DataFrame) -> DataFrame:
    """(topic, term, weight) of H."""
    return h.select("term", F.posexplode("h").alias("topic", "weight")).select("topic", "term", "weight")


def top_words(h: DataFrame, n: int = SUMMARY_WORDS, topic: int | None = None) -> DataFrame:
    """The ``n`` heaviest terms of each topic, ties by term; each task passes on ``n`` at most."""
    rows = topic_terms(h)
    if topic is not None:
        rows = rows.filter(F.col("topic") == topic)
    order = W.partitionBy("topic").orderBy(F.desc("weight"), F.asc("term"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def word_frequency(h: DataFrame) -> DataFrame:
    """(topic, term, frequency): weight by the weight of the topic, NULL for an empty topic."""
    rows = topic_terms(h)
    totals = rows.groupBy("topic").agg(F.sum("weight").alias("total"))  # one row per topic
    return rows.join(F.broadcast(totals), "topic").select(
        "topic", "term", F.try_divide("weight", "total").alias("frequency")
    )


def cloud_words(h: DataFrame, n: int = CLOUD_WORDS) -> DataFrame:
    """The ``n`` most frequent words of each topic with their frequency."""
    order = W.partitionBy("topic").orderBy(F.desc("frequency"), F.asc("term"))
    return word_frequency(h).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def topic_shares(w: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, topic, pct): share of every topic in a document, NULL where all weights are zero."""
    total = vector_sum(F.col("w"))
    return w.select(
        id_col, F.posexplode(F.transform("w", lambda v: F.try_divide(v, total))).alias("topic", "pct")
    )


def topic_labels(w: DataFrame, share: float = LABEL_SHARE, id_col: str = "doc_id") -> DataFrame:
    """Topics holding at least ``share`` of a document."""
    return topic_shares(w, id_col).filter(F.col("pct") >= share)


def document_topics(w: DataFrame, share: float = LABEL_SHARE, id_col: str = "doc_id", doc_id=None) -> DataFrame:
    """(id, topics): labelled topics of each document as (pct, topic), largest first, ties by topic."""
    if doc_id is not None:
        w = w.filter(F.col(id_col) == doc_id)
    total = vector_sum(F.col("w"))
    pairs = F.transform("w", lambda v, i: F.struct((-F.try_divide(v, total)).alias("minus"), i.alias("topic")))
    kept = F.array_sort(F.filter(pairs, lambda p: p["minus"] <= -share))
    shown = F.transform(kept, lambda p: F.struct((-p["minus"]).alias("pct"), p["topic"].alias("topic")))
    return w.select(id_col, shown.alias("topics"))


def topic_sizes(w: DataFrame, topics: int, share: float = LABEL_SHARE, id_col: str = "doc_id") -> DataFrame:
    """(topic, n_docs) for every topic, zero included."""
    numbers = w.sparkSession.range(topics).select(F.col("id").cast("int").alias("topic"))
    counts = topic_labels(w, share, id_col).groupBy("topic").agg(F.count(F.lit(1)).alias("n_docs"))
    return numbers.join(counts, "topic", "left").select("topic", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def largest_topics(w: DataFrame, topics: int, n: int = 3, share: float = LABEL_SHARE, id_col: str = "doc_id") -> DataFrame:
    return topic_sizes(w, topics, share, id_col).orderBy(F.desc("n_docs"), F.asc("topic")).limit(n)


def topic_summary(
    h: DataFrame,
    w: DataFrame,
    topics: int,
    num_words: int = SUMMARY_WORDS,
    share: float = LABEL_SHARE,
    id_col: str = "doc_id",
) -> DataFrame:
    """(topic, n_docs, words): size and heaviest terms of each topic."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    words = top_words(h, num_words).groupBy("topic").agg(F.transform(ordered, lambda s: s["term"]).alias("words"))
    return topic_sizes(w, topics, share, id_col).join(words, "topic", "left")


def topic_similarity(h: DataFrame, topics: int) -> DataFrame:
    """(topic_a, topic_b, cosine) of every pair a < b, from one pass over H; 0 for an empty topic."""
    dots = cross_moments(h, "h", "h", topics, topics)
    norms = dots.filter(F.col("i") == F.col("j")).select("i", F.sqrt("value").alias("norm"))
    left = norms.select("i", F.col("norm").alias("norm_a"))
    right = norms.select(F.col("i").alias("j"), F.col("norm").alias("norm_b"))
    cosine = F.try_divide("value", F.col("norm_a") * F.col("norm_b"))
    return (
        dots.filter(F.col("i") < F.col("j"))
        .join(F.broadcast(left), "i")  # topics are few: every side here has at most one row per pair
        .join(F.broadcast(right), "j")
        .select(F.col("i").alias("topic_a"), F.col("j").alias("topic_b"), F.coalesce(cosine, F.lit(0.0)).alias("cosine"))
    )


def mean_similarity(h: DataFrame, topics: int) -> DataFrame:
    """One row (topics, mean_cosine); 1 for a single topic."""
    mean = F.coalesce(F.avg("cosine"), F.lit(1.0)).alias("mean_cosine")
    return topic_similarity(h, topics).agg(mean).select(F.lit(topics).alias("topics"), "mean_cosine")


def mean_similarity_of_columns(h: DataFrame, topics: int) -> DataFrame:
    """Mean similarity taken over the first ``topics`` terms instead of over the topics.

    For two terms the value is the share of topic pairs in which the first term
    has weight in one topic and the second in the other.
    """
    filled = F.size(F.filter("h", lambda v: v > 0)).cast("double")
    first = h.filter(F.col("term_idx") < topics).select("term_idx", filled.alias("filled"))
    # sum over pairs a < b of f(a) f(b) equals (sum(f)^2 - sum(f^2)) / 2
    pairs = (F.sum("filled") * F.sum("filled") - F.sum(F.col("filled") * F.col("filled"))) / 2
    number = topics * (topics - 1) / 2
    mean = F.lit(1.0) if topics == 1 else pairs / F.lit(number * topics * topics)
    return first.agg(mean.alias("mean_cosine")).select(F.lit(topics).alias("topics"), "mean_cosine")


def topic_sweep(
    matrix: DataFrame,
    vocabulary: DataFrame,
    topic_counts: Iterable[int],
    settings: NMFSettings,
    id_col: str = "doc_id",
    as_coded: bool = False,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(topics, error, mean_cosine, converged) for each number of topics, fitted side by side.

    Numbers whose H is larger than ``max_bytes`` are fitted one after another by ``nmf_fit``,
    which looks H up by term.
    """
    spark = matrix.sparkSession
    counts = [int(k) for k in topic_counts]
    terms = vocabulary.count()
    large = [k for k in counts if terms * k * 8 > max_bytes]
    small = [k for k in counts if terms * k * 8 <= max_bytes]
    rows = [
        (fit.topics, fit.errors[-1], fit.mean_cosine_of_columns() if as_coded else fit.mean_cosine(), fit.converged)
        for fit in (fit_side_by_side(matrix, vocabulary, small, settings, id_col, max_bytes) if small else [])
    ]
    if large:
        placed = place_by_document(matrix, id_col)
        measure = mean_similarity_of_columns if as_coded else mean_similarity
        for k in large:
            model = nmf_fit(matrix, vocabulary, replace(settings, topics=k), id_col, max_bytes, placed)
            rows.append((k, model.errors[-1], measure(model.h, k).first()["mean_cosine"], model.converged))
            model.unpersist()
        placed.unpersist()
    return spark.createDataFrame(rows, "topics int, error double, mean_cosine double, converged boolean")


def shared_topics(pro: NMFModel, con: NMFModel, threshold: float = 0.3) -> DataFrame:
    """(pro_topic, con_topic, cosine): the best partner of each topic of the first corpus.

    Terms are matched between the corpora; only best partners reaching
    ``threshold`` are listed, ties by topic.
    """
    k, m = pro.topics, con.topics
    left, right = pro.h.select("term", F.col("h").alias("p")), con.h.select("term", F.col("h").alias("c"))
    both = (
        left.join(right, "term", "full")
        .withColumn("p", F.coalesce("p", F.array(*[F.lit(0.0)] * k)))
        .withColumn("c", F.coalesce("c", F.array(*[F.lit(0.0)] * m)))
        .select(F.concat("p", "c").alias("h"))
    )
    pairs = topic_similarity(both, k + m).filter((F.col("topic_a") < k) & (F.col("topic_b") >= k))
    best = W.partitionBy("topic_a").orderBy(F.desc("cosine"), F.asc("topic_b"))
    return (
        pairs.withColumn("rank", F.row_number().over(best))
        .filter((F.col("rank") == 1) & (F.col("cosine") >= threshold))
        .select(F.col("topic_a").alias("pro_topic"), (F.col("topic_b") - k).alias("con_topic"), "cosine")
    )
