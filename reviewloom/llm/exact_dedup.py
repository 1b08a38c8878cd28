"""Exact duplicates by skew-safe combining, in built-in expressions.

Copies are merged in each task, then per digest and salt, then per digest. The full
text is a grouping column each time, so texts are equal only when they are identical.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import body, keep, table

SALTS = 16
HOT_SHARE = 1000
ROW = "__exact_row"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number that is the same each time a stored table is scanned."""
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def _winner() -> list[Column]:
    """Largest id of a group, the row that has it (any row where all ids are NULL), and the size."""
    return [
        F.max("id").alias("id"),
        F.coalesce(F.max_by("row", "id"), F.max("row")).alias("row"),
        F.sum("n").alias("n"),
    ]


def copy_groups(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    """One kept row per digest: ``digest, variants, id, row, n`` over all its texts.

    A map-side partial aggregate merges the copies of a task before anything moves.
    The salt follows the task, so at most ``salts`` rows of one text reach the last step.
    """
    text = body(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(ROW).alias("row"),
        F.lit(1).cast("long").alias("n"),
        digest(text).alias("digest"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
        text.alias("text"),
    )
    salted = rows.groupBy("digest", "salt", "text").agg(*_winner())
    texts = salted.repartition("digest").groupBy("digest", "text").agg(*_winner())
    return keep(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("variants"), *_winner()))


def _by_digest(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the winner of their digest; the few largest groups are broadcast, their rows stay in place.

    Fewer than ``HOT_SHARE`` groups can hold more than one in ``HOT_SHARE`` rows, so
    what is broadcast is bounded.
    """
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = (F.col("n") > HOT_SHARE) & (F.col("n") * HOT_SHARE > total)
    hot = groups.filter(large).select("digest", *[F.col(c).alias(f"hot_{c}") for c in ("id", "row", "n")])
    cold = groups.filter(~large).select(
        F.col("digest").alias("cold_digest"), *[F.col(c).alias(f"cold_{c}") for c in ("id", "row", "n")]
    )
    marked = rows.join(F.broadcast(hot), "digest", "left")
    # rows that are done take a key of their own, which matches nothing and spreads them
    key = F.when(F.col("hot_n").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("row")))
    joined = marked.withColumn("cold_key", key).join(cold, F.col("cold_key") == F.col("cold_digest"), "left")
    return joined.select(
        "doc_id", "row", "digest", *[F.coalesce(f"hot_{c}", f"cold_{c}").alias(f"keep_{c}") for c in ("id", "row", "n")]
    )


def mark_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """Every row with its group: ``doc_id, keep_id, group_size, kept, text_sha256``, and its ``row`` number.

    Of equal texts the row with the largest id stays; of rows equal in both, one of
    them; NULL ids lose to any other. NULL texts count as empty. An empty table gives
    no rows. Other columns are not read. ``docs`` must be a stored table.

    Where a digest has one text, which the grouping by full texts has shown, rows find
    their group by the digest alone. Rows of a digest with several texts, if there are
    any, are grouped and looked up by the text itself.
    """
    numbered = _numbered(docs)
    groups = copy_groups(numbered, id_col, text_col, digest, salts)
    text = body(text_col)
    rows = numbered.select(
        F.col(id_col).alias("doc_id"), F.col(ROW).alias("row"), digest(text).alias("digest"), text.alias("text")
    )
    sha = F.col("digest") if digest is sha256 else None
    shaped = []
    clashing = groups.filter("variants > 1").select("digest")
    if not clashing.isEmpty():
        alike = rows.withColumn("sha", sha256(F.col("text"))).join(clashing, "digest", "left_semi")
        exact = (
            alike.withColumn("n", F.lit(1).cast("long"))
            .withColumnRenamed("doc_id", "id")
            .groupBy("digest", "text")
            .agg(*_winner())
            .select("digest", "text", *[F.col(c).alias(f"keep_{c}") for c in ("id", "row", "n")])
        )
        shaped.append(alike.join(exact, ["digest", "text"]))
        rows = rows.join(clashing, "digest", "left_anti")
        groups = groups.filter("variants = 1")
    if sha is None:
        rows = rows.withColumn("sha", sha256(F.col("text")))
        shas = rows.select("row", "sha")
        shaped.append(_by_digest(rows.select("doc_id", "row", "digest"), groups).join(shas, "row"))
    else:
        shaped.append(_by_digest(rows.select("doc_id", "row", "digest"), groups).withColumn("sha", sha))
    out = [
        part.select(
            "doc_id",
            F.col("keep_id"),
            F.col("keep_n").alias("group_size"),
            (F.col("row") == F.col("keep_row")).alias("kept"),
            F.col("sha").alias("text_sha256"),
            "row",
        )
        for part in shaped
    ]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that lose to an equal text; all columns stay. See ``mark_copies``."""
    kept = mark_copies(docs, id_col, text_col).filter("kept").select(F.col("row").alias(ROW))
    return _numbered(docs).join(kept, ROW, "left_semi").drop(ROW)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents")).drop("row")


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
