"""Non-negative matrix factorisation X ~ W H of a long weight table.

W has one row of ``k`` numbers per document, H one per term. For a fixed H every
row of W is a small non-negative least-squares problem of its own, and the other
way round; the fit alternates between the two. One round over X needs

* a lookup of H by term and a sum by document, both where X lies,
* the solution of the document problems on Arrow batches,
* a sum by term, combined in each task before its shuffle,
* the solution of the term problems.

Only H is carried between rounds. It is checkpointed in each, so lineage stays
short and a lost executor costs at most one round. The driver sees k by k
matrices only.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.vectors import moment_matrix, nonnegative_solver, violation
from reviewloom.operators.lookup import BROADCAST_BYTES, lookup_join
from reviewloom.session import ensure_checkpoint_dir, placed_partitions


@dataclass(frozen=True)
class NMFSettings:
    """``alpha`` and ``l1_ratio`` penalise both factors: the sum of entries and half the sum of squares.

    ``sweeps`` bounds the steps of one small problem, which without it go on until
    it settles. ``max_rounds`` bounds the fit; a fit it cuts short warns and is marked.
    """

    topics: int
    alpha: float = 0.1
    l1_ratio: float = 0.5
    seed: int = 42
    seed_documents: int = 3
    max_rounds: int = 200
    tol: float = 1e-4
    sweeps: int | None = None
    sweep_tol: float = 1e-6

    @property
    def l1(self) -> float:
        return self.alpha * self.l1_ratio

    @property
    def l2(self) -> float:
        return self.alpha * (1.0 - self.l1_ratio)


@dataclass
class NMFModel:
    """Fitted factors: ``h`` (term, term_idx, h), ``w`` (id, w) of documents holding a term.

    ``objectives`` has the penalised objective after each round, ``errors`` the
    Frobenius norm of X - WH after each document step, ``converged`` tells whether the
    fit settled before its rounds were used up.
    """

    settings: NMFSettings
    h: DataFrame
    w: DataFrame
    id_col: str
    objectives: list[float] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    held: list = field(default_factory=list)
    converged: bool = False

    @property
    def topics(self) -> int:
        return self.settings.topics

    def unpersist(self) -> None:
        for kept in self.held:
            kept.unpersist()
        self.held.clear()


@dataclass(frozen=True)
class Placed:
    """(id, x, term_idx) kept by document and in document order, in so many partitions."""

    weights: DataFrame
    id_col: str
    partitions: int

    def keep(self, df: DataFrame) -> DataFrame:
        """Lay a table out like the weights, so that joining the two by document moves neither."""
        return (
            df.repartition(self.partitions, self.id_col)
            .sortWithinPartitions(self.id_col)
            .persist(StorageLevel.MEMORY_AND_DISK)
        )

    def unpersist(self) -> None:
        self.weights.unpersist()


def place_by_document(matrix: DataFrame, id_col: str) -> Placed:
    """Keep the weights of a fit.

    They are written once to the checkpoint folder, so that rounds do not plan or
    repeat the weighting. They are placed after that: a checkpoint does not
    remember where its rows lie.
    """
    spark = matrix.sparkSession
    ensure_checkpoint_dir(spark)
    weights = matrix.select(id_col, "term_idx", F.col("tfidf").alias("x")).checkpoint()
    layout = Placed(weights, id_col, placed_partitions(spark, weights.count()))
    return Placed(layout.keep(weights), id_col, layout.partitions)


def start_documents(x: DataFrame, wanted: int, seed: int, id_col: str = "doc_id") -> list:
    """Ids of the ``wanted`` documents with the smallest digests of id and seed, in that order."""
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    return [row[0] for row in x.select(id_col).distinct().orderBy(digest, id_col).limit(wanted).collect()]


def initial_h(
    x: DataFrame, vocabulary: DataFrame, topics: int, seed: int, seed_documents: int = 3, id_col: str = "doc_id"
) -> DataFrame:
    """(term_idx, h) to start from: each topic is the mean of a few documents of its own.

    The documents are those with the smallest digests of id and seed, dealt out in
    turn, so the start is reproducible. Unlike noise, which makes all topics alike
    and lets the penalty empty all but one, documents point in different directions.
    """
    ids = start_documents(x, topics * seed_documents, seed, id_col)
    schema = f"{id_col} {x.schema[id_col].dataType.simpleString()}, topic int"
    dealt = x.sparkSession.createDataFrame([(doc, i % topics) for i, doc in enumerate(ids)], schema)
    means = ", ".join(f"sum(if(topic = {t}, x, 0D)) / {seed_documents}D" for t in range(topics))
    picked = x.join(F.broadcast(dealt), id_col).groupBy("term_idx").agg(F.expr(f"array({means})").alias("h"))
    zero = F.array(*[F.lit(0.0)] * topics)
    return vocabulary.select("term_idx").join(picked, "term_idx", "left").select(
        "term_idx", F.coalesce("h", zero).alias("h")
    )


def _weighted_sum(vector: str, topics: int) -> Column:
    """Sum of ``x`` times a vector, as one generated aggregate of ``topics`` plain sums."""
    return F.expr("array(" + ", ".join(f"sum(x * {vector}[{t}])" for t in range(topics)) + ")")


def factor_bytes(h: DataFrame, topics: int) -> int:
    """Size of H in memory, from its number of terms."""
    return h.count() * (topics * 8 + 64)


def document_targets(
    x: DataFrame, h: DataFrame, id_col: str, topics: int, h_bytes: int, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(id, a): the rows of X H'. H is broadcast when it is small, split by hot terms otherwise."""
    joined = lookup_join(x, h.select("term_idx", "h"), "term_idx", table_bytes=h_bytes, max_bytes=max_bytes)
    return joined.groupBy(id_col).agg(_weighted_sum("h", topics).alias("a"))


def term_targets(x: DataFrame, w: DataFrame, id_col: str, topics: int) -> DataFrame:
    """(term_idx, b): the columns of W'X. X is neither moved nor sorted; W comes to it by document."""
    joined = x.join(w.select(id_col, "w").hint("merge"), id_col)
    return joined.groupBy("term_idx").agg(_weighted_sum("w", topics).alias("b"))


def solve_documents(
    x: DataFrame,
    h: DataFrame,
    gram: np.ndarray,
    settings: NMFSettings,
    id_col: str,
    h_bytes: int,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, a, w): document factors for a fixed H with Gram matrix ``gram``."""
    solve = _solver(gram, settings)
    return document_targets(x, h, id_col, settings.topics, h_bytes, max_bytes).withColumn("w", solve("a"))


def _solver(gram: np.ndarray, settings: NMFSettings):
    return nonnegative_solver(gram, settings.l1, settings.l2, settings.sweeps, settings.sweep_tol)


def _gram(h: DataFrame, topics: int) -> np.ndarray:
    return moment_matrix(h, "h", "h", topics, topics, _tasks(h))


def _tasks(df: DataFrame) -> int:
    """Most tasks a kept or checkpointed factor table has."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _moments(df: DataFrame, factor: str, target: str, topics: int) -> tuple[np.ndarray, float, float]:
    """Gram matrix of a factor, its product sum with its target, and its total, in one pass."""
    wide = df.select(factor, F.concat(factor, target, F.array(F.lit(1.0))).alias("_wide"))
    both = moment_matrix(wide, factor, "_wide", topics, 2 * topics + 1, _tasks(df))
    return both[:, :topics], float(np.trace(both[:, topics : 2 * topics])), float(both[:, -1].sum())


def nmf_fit(
    matrix: DataFrame,
    vocabulary: DataFrame,
    settings: NMFSettings,
    id_col: str = "doc_id",
    max_bytes: int = BROADCAST_BYTES,
    placed: Placed | None = None,
) -> NMFModel:
    """Fit W and H; stops when a round lowers the objective by less than ``tol`` of it.

    ``placed`` may pass the result of ``place_by_document`` to share it between fits.
    """
    spark = matrix.sparkSession
    ensure_checkpoint_dir(spark)
    k = settings.topics
    layout = place_by_document(matrix, id_col) if placed is None else placed
    x = layout.weights
    x_square = x.agg(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).first()[0]
    h = initial_h(x, vocabulary, k, settings.seed, settings.seed_documents, id_col).checkpoint()
    h_bytes = factor_bytes(h, k)
    gram = _gram(h, k)
    model = NMFModel(settings, h, h, id_col, held=[layout] if placed is None else [])
    done = model.objectives
    for _ in range(settings.max_rounds):
        # the moments pass also fills the kept table of document factors
        w = layout.keep(solve_documents(x, h, gram, settings, id_col, h_bytes, max_bytes))
        w_gram, cross, w_sum = _moments(w, "w", "a", k)
        model.errors.append(_error(x_square, cross, w_gram, gram))

        h = term_targets(x, w, id_col, k).withColumn("h", _solver(w_gram, settings)("b")).checkpoint()
        w.unpersist()
        gram, cross, h_sum = _moments(h, "h", "b", k)
        fit = 0.5 * _error(x_square, cross, w_gram, gram) ** 2
        penalty = settings.l1 * (w_sum + h_sum) + 0.5 * settings.l2 * float(np.trace(w_gram) + np.trace(gram))
        done.append(fit + penalty)
        if len(done) > 1 and done[-2] - done[-1] <= settings.tol * done[-2]:
            model.converged = True
            break
    else:
        if settings.tol >= 0:  # below it, a fixed number of rounds is asked for
            warnings.warn(f"{k} topics have not settled in {settings.max_rounds} rounds", stacklevel=2)
    w = layout.keep(solve_documents(x, h, gram, settings, id_col, h_bytes, max_bytes))
    w_gram, cross, _ = _moments(w, "w", "a", k)
    model.errors.append(_error(x_square, cross, w_gram, gram))
    model.h = vocabulary.select("term", "term_idx").join(h.select("term_idx", "h"), "term_idx")
    model.w = w.select(id_col, "w")
    model.held.append(w)
    return model


def _error(x_square: float, cross: float, w_gram: np.ndarray, h_gram: np.ndarray) -> float:
    return float(np.sqrt(max(0.0, x_square - 2.0 * cross + np.sum(w_gram * h_gram))))


def nmf_transform(
    matrix: DataFrame, h: DataFrame, settings: NMFSettings, id_col: str = "doc_id", docs: DataFrame | None = None
) -> DataFrame:
    """(id, w) of documents for a fitted H (term_idx, h).

    With ``docs`` every one of them gets a row; one without any term gets zeros.
    """
    x = matrix.select(id_col, "term_idx", F.col("tfidf").alias("x"))
    h_bytes = factor_bytes(h, settings.topics)
    w = solve_documents(x, h, _gram(h, settings.topics), settings, id_col, h_bytes).select(id_col, "w")
    if docs is None:
        return w
    zero = F.array(*[F.lit(0.0)] * settings.topics)
    return docs.select(id_col).join(w, id_col, "left").withColumn("w", F.coalesce("w", zero))


def reconstruction_error(matrix: DataFrame, w: DataFrame, h: DataFrame, topics: int, id_col: str = "doc_id") -> float:
    """Frobenius norm of X - WH, touching only the non-zero weights of X."""
    x = matrix.select(id_col, "term_idx", F.col("tfidf").alias("x"))
    x_square = x.agg(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).first()[0]
    targets = document_targets(x, h, id_col, topics, factor_bytes(h, topics))
    w_gram, cross, _ = _moments(w.select(id_col, "w").join(targets, id_col), "w", "a", topics)
    return _error(x_square, cross, w_gram, _gram(h, topics))


def optimality(matrix: DataFrame, model: NMFModel, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(part, key, breach): how far each document and each term of a fit is from optimal, the other factor held fixed.

    A row is optimal where its slope is zero in positive entries and not negative in
    others; ``breach`` is the worst exception relative to the row's largest target. Documents
    are solved last and keep to the solver's tolerance; terms come as near as the fit has settled.
    """
    s, k, id_col = model.settings, model.topics, model.id_col
    x = matrix.select(id_col, "term_idx", F.col("tfidf").alias("x"))
    h = model.h.select("term", "term_idx", "h")
    targets = document_targets(x, h, id_col, k, factor_bytes(h, k), max_bytes)
    of_documents = violation(_gram(h, k), s.l1, s.l2)
    documents = model.w.join(targets, id_col).select(
        F.lit("document").alias("part"), F.col(id_col).cast("string").alias("key"), of_documents("w", "a").alias("breach")
    )
    of_terms = violation(moment_matrix(model.w, "w", "w", k, k, _tasks(model.w)), s.l1, s.l2)
    terms = h.join(term_targets(x, model.w, id_col, k), "term_idx").select(
        F.lit("term").alias("part"), F.col("term").alias("key"), of_terms("h", "b").alias("breach")
    )
    return documents.unionByName(terms)
