"""Quality by hierarchical empirical Bayes.

Boosted trees over surface features of the whole text give the evidence of a document.
Sums of it by host and by path below the host give site posteriors: a path is drawn
towards its host and a host towards all documents, the more the fewer documents it has.
How strongly is read off the spread between sites. Evidence and site prior are added as
log odds.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import boosting
from reviewloom.llm.common import body, keep, share, table
from reviewloom.llm.toxicity import labelled_sample
from reviewloom.operators.lookup import lookup_join

EXAMPLES = 20_000  # labelled rows to learn from, at most
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 10_000.0
SYMBOLS = "#$%&*"


def surface(text: str) -> list[float]:
    """Features of a whole text: case, symbols, separators, repeats and length."""
    words = text.split()
    n = len(words) or 1
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    return [
        math.log1p(len(words)),
        sum(map(str.isupper, words)) / n,
        text.count("!") / n,
        sum(map(text.count, SYMBOLS)) / n,
        (text.count("|") + text.count("\t") + text.count(";")) / n,
        (text.count(".") + text.count("?")) / n,
        text.count(",") / n,
        again / n,
        max(counts.values(), default=0) / n,
        math.log(len(counts) + 1) / math.log(n + 1),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        len(text) / n,
        sum(map(str.isalpha, words)) / n,
        sum(map(text.count, "0123456789")) / n,
        sum(map(text.count, "<>{}[]()=_/\\@")) / n,
    ]


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = EXAMPLES
) -> boosting.Trees | None:
    """Trees of at most ``most`` labelled rows that are not held out; None where one of the labels is missing."""
    sample = labelled_sample(docs, labels, label, id_col, text_col, most)

    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return texts.map(surface)

    # as columns: rows of numbers as objects take many times the room in the driver
    rows = sample.select("label", described("text").alias("x")).toArrow()
    y = (rows.column("label").to_numpy() == 1).astype(np.float64)
    if len(set(y.tolist())) < 2:
        return None
    return boosting.fit(rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1), y)


def evidence(spark: SparkSession, model: boosting.Trees | None, text: Column) -> Column:
    """Probability that a text is good, by the text alone; 1 without a model."""
    if model is None:
        return F.lit(1.0)
    shared = share(spark, model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees = pickle.loads(shared.value)
        for texts in batches:
            scores = trees.scores(np.array([surface(t) for t in texts]).reshape(len(texts), -1))
            yield pd.Series(1 / (1 + np.exp(-np.clip(scores, -30, 30))))

    return scored(text)


def _strength(share: float, sites: DataFrame, mean: str, n: str) -> float:
    """Documents a prior is worth: the less sites differ beyond chance, the more (moments of a beta-binomial)."""
    within = share * (1 - share)
    row = sites.agg(
        F.sum(F.col(n) * (F.col(mean) - share) ** 2).alias("between"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("k")
    ).first()
    if not row.k or row.k < 2 or within <= 0:
        return MOST_STRENGTH
    spread = max((row.between - (row.k - 1) * within) / row.n, within / MOST_STRENGTH)
    return min(max(within / spread - 1, LEAST_STRENGTH), MOST_STRENGTH)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def _site(host: str, path: str) -> Column:
    """Key of a site; hashes skip NULLs, so where they stand is hashed too."""
    return F.xxhash64(F.col(host), F.col(path), F.col(host).isNull(), F.col(path).isNull())


def site_priors(scored: DataFrame, host: str, path: str, p: str) -> tuple[DataFrame, float, float]:
    """(``site, total, n, host_prior`` per path, share of good documents, documents the host prior is worth).

    Sums are combined in each task before they move, so a host with a third of all rows
    sends one row per task.
    """
    paths = keep(
        scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.sum(p).alias("total"), F.count(F.lit(1)).alias("n"))
    )
    whole = paths.agg(F.sum("total"), F.sum("n")).first()
    share = min(max(whole[0] / whole[1], 1e-6), 1 - 1e-6) if whole[1] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("total").alias("host_total"), F.sum("n").alias("host_n"))
    worth = _strength(share, hosts.withColumn("mean", F.col("host_total") / F.col("host_n")), "mean", "host_n")
    hosts = hosts.withColumn("host_prior", (F.col("host_total") + worth * share) / (F.col("host_n") + worth))
    hosts = hosts.select(F.col("host").alias("_host"), "host_prior")
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).select("host", "path", "total", "n", "host_prior")
    path_worth = _strength(share, joined.withColumn("mean", F.col("total") / F.col("n")), "mean", "n")
    return joined.select(_site("host", "path").alias("site"), "total", "n", "host_prior"), share, path_worth


def rate_documents(
    docs: DataFrame,
    labels: DataFrame,
    host: str = "source",
    path: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    model: boosting.Trees | None = None,
) -> DataFrame:
    """``docs`` with ``__document``, ``__site`` and ``__quality``: probabilities of being good, by text, site and both.

    The site's share leaves the document itself out. NULL hosts and paths are sites of
    their own; NULL texts count as empty; repeated rows are rated alike; without labels of
    both kinds every text counts as good; an empty table gives no rows.
    """
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col)
    scored = docs.withColumn("__document", evidence(docs.sparkSession, model, body(text_col)))
    narrow = scored.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col("__document").alias("p"))
    sites, share, worth = site_priors(narrow, "host", "path", "p")
    sites = keep(
        sites.groupBy(F.col("site").alias("__key")).agg(
            F.sum("total").alias("__total"), F.sum("n").alias("__n"), F.max("host_prior").alias("__prior")
        )
    )
    keyed = scored.withColumn("__key", _site(host, path))
    joined = lookup_join(keyed, sites, "__key", "left", key_rows=sites.select("__key", F.col("__n").alias("n")))
    others = (F.col("__total") - F.col("__document") + worth * F.col("__prior")) / (F.col("__n") - 1 + worth)
    odds = _logit(F.col("__document")) + _logit(F.col("__site")) - _logit(F.lit(share))
    rated = joined.withColumn("__site", others).withColumn("__quality", 1 / (1 + F.exp(-odds)))
    return rated.select(*docs.columns, "__document", "__site", "__quality")


def drop_poor(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` without the rows more likely poor than good; all columns stay."""
    return rate_documents(docs, labels, host, path).filter(F.col("__quality") >= 0.5).select(*docs.columns)


def op7_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select(
        "doc_id",
        F.col("__document").alias("document_score"),
        F.col("__site").alias("site_score"),
        F.col("__quality").alias("quality"),
        (F.col("__quality") >= 0.5).alias("kept"),
    )
