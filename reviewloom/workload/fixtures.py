"""Views of the benchmark tables in the shape of the review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.text import tokens
from reviewloom.operators.rows import explode_rows
from reviewloom.sources import read_spread

MIN_RATINGS = 30
JUNK = ("That it.",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as employers; line items are counted per part before the join."""
    counts = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("company_id"))
        .agg(F.count(F.lit(1)).alias("num_ratings"), (F.avg("l_quantity") / 10).alias("overall_rating"))
    )
    names = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("company_id"), F.col("p_name").alias("company_name"), F.col("p_brand").alias("industry")
    )
    return counts.join(names, "company_id").select(
        "company_id", "company_name", "industry", "num_ratings", "overall_rating"
    )


def reviews(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """Documents as reviews, their quality label as polarity."""
    path = f"{sf_dir}/documents.parquet"
    docs = read_spread(spark, path, "doc_id") if spread else spark.read.parquet(path)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    polarity = F.when(F.col("quality") == 1, "pro").when(F.col("quality") == 0, "con")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("source").alias("company_name"), polarity.alias("pro_or_con"), F.col("text").alias("review_text")
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as employers to check, with known gaps against their reviews."""
    source = F.col("source")
    wanted = F.when(source.isin("src0", "src1", "src2"), F.col("n") * 3).when(source == "src3", F.col("n") * 2)
    rating = F.when(source == "src0", 4.4).when(source == "src1", 2.4).otherwise(3.5)
    known = (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.substring("source", 4, 10).cast("long").alias("company_id"),
            source.alias("company_name"),
            wanted.otherwise(F.col("n")).alias("num_ratings"),
            rating.alias("overall_rating"),
        )
    )
    absent = spark.createDataFrame([(999, "absent", 100, 4.8)], known.schema)
    return known.unionByName(absent)


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON result pages of at most 50 employers."""
    part = table(spark, sf_dir, "part")
    employer = F.struct(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_size").cast("string").alias("numberOfRatings"),
        F.col("p_retailprice").alias("overallRating"),
        (F.col("p_retailprice") / 4).cast("string").alias("cultureAndValuesRating"),
        F.col("p_type").alias("recommendToFriendRating"),
        F.col("p_brand").alias("industryName"),
    )
    return (
        part.groupBy(F.floor(F.col("p_partkey") / 50).alias("page"))
        .agg(F.collect_list(employer).alias("employers"))
        .select(
            F.to_json(
                F.struct(
                    F.lit(True).alias("success"),
                    F.struct(F.lit(1).alias("totalNumberOfPages"), F.col("employers")).alias("response"),
                )
            ).alias("body")
        )
    )


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as responses; one that breaks off counts as failed."""
    return table(spark, sf_dir, "pages").select(
        (F.col("page_id") + 1).alias("page_num"), F.col("html").contains("</html>").alias("success")
    )


def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as review pages, fetched for the two polarities in turn."""
    pages = read_spread(spark, f"{sf_dir}/pages.parquet", "page_id")
    return pages.select(
        F.col("page_id").alias("company_id"),
        F.col("url").alias("company_name"),
        F.when(F.col("page_id") % 2 == 0, "pro").otherwise("con").alias("pro_or_con"),
        "html",
    )


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One first page per employer in the real layout, from its counts."""
    block = '<div class="cell reviewBodyCell"><div>a</div><p>b</p></div>'
    return employers(spark, sf_dir).select(
        "company_id",
        F.concat(
            F.lit("<h1>x</h1><h2> "),
            F.format_number(F.col("num_ratings") * 37, 0),
            F.lit(" Reviews</h2>"),
            F.repeat(F.lit(block), (F.col("num_ratings") % 11).cast("int")),
        ).alias("html"),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon of the benchmark tokens, with made-up lemmas and parts of speech."""
    token = F.col("token")
    kind = F.length("token") % 4
    return (
        explode_rows(table(spark, sf_dir, "benchmark"), tokens(F.col("text")), "token")
        .distinct()
        .select(
            "token",
            F.when(token.isin("on", "that"), F.lit("bos")).otherwise(F.substring("token", 1, 5)).alias("lemma"),
            F.when(kind == 0, "NOUN").when(kind == 1, "VERB").when(kind == 2, "DET").otherwise("ADJ").alias("pos"),
        )
    )
