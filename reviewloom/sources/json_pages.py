"""Landed result pages of the employer listing, one JSON object per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.schemas import EMPLOYER_KEYS, EMPLOYER_PAGE, EMPLOYERS, RATING_COLUMNS

MAX_TRIES = 5


def parse_pages(df: DataFrame, json_col: str = "body") -> DataFrame:
    """Parse a text column holding pages; the other columns stay."""
    return df.withColumn("page", F.from_json(json_col, EMPLOYER_PAGE)).drop(json_col).select("*", "page.*").drop("page")


def explode_employers(pages: DataFrame) -> DataFrame:
    """One row per employer of every page, as source documents."""
    return pages.select(F.explode("response.employers").alias("employer")).select("employer.*")


def _rating(column: Column) -> Column:
    number = column.try_cast("double")
    return F.when(~F.isnan(number), number)


def project_employers(documents: DataFrame) -> DataFrame:
    """Typed employer table; a missing key or a NaN rating becomes NULL.

    NaN must not survive: Spark orders it above every number, which would put
    unrated employers into the upper tail.
    """
    types = {f.name: f.dataType for f in EMPLOYERS}
    return documents.select(
        *[
            (_rating(F.col(key)) if name in RATING_COLUMNS else F.col(key).try_cast(types[name])).alias(name)
            for name, key in EMPLOYER_KEYS.items()
        ]
    )


def rejected_employers(documents: DataFrame) -> DataFrame:
    """Documents whose id or rating count is no whole number."""
    bad = [F.col(EMPLOYER_KEYS[c]).try_cast("long").isNull() for c in ("company_id", "num_ratings")]
    return documents.filter(bad[0] | bad[1])


def landed_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, body): the pages of each landed file; a page landed twice with the same content once.

    A file whose first line is a document, or that has a line that is a page, holds one
    page in each line, and ``line`` counts them from 1. Any other file is one page, which
    may span lines, with ``line`` 1. An empty file has no row; ``missing_pages`` lists its
    page as it does one that never landed.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("_text"))
    lines = F.filter(F.split("_text", r"\r\n|\n|\r"), lambda t: F.length(F.trim(t)) > 0)
    each = files.withColumn("_lines", lines)
    one_a_line = (F.size("_lines") > 1) & (
        _one_document(F.get("_lines", F.lit(0))) | F.exists("_lines", lambda t: ~broken_page(t))
    )
    bodies = F.when(one_a_line, F.col("_lines")).otherwise(F.array("_text"))
    found = each.select("file", F.posexplode(bodies).alias("line", "body"))
    return found.withColumn("line", F.col("line") + 1).dropDuplicates(["body"])


def _one_document(json: Column) -> Column:
    """Whether a text is one JSON object and nothing else.

    ``from_json`` ignores what follows the first document, so the text is read as the
    first of two elements of an array.
    """
    pair = F.from_json(F.concat(F.lit("["), json, F.lit(',{"_end":1}]')), "array<struct<_end: string>>")
    return F.coalesce((F.size(pair) == 2) & pair[0].isNotNull() & (pair[1]["_end"] == "1"), F.lit(False))


def broken_page(json_col: str | Column = "body") -> Column:
    """Whether a text is no page: it does not parse as a whole, more follows the page, or it holds no response."""
    json = F.col(json_col) if isinstance(json_col, str) else json_col
    schema = T.StructType([*EMPLOYER_PAGE.fields, T.StructField("_broken", T.StringType())])
    parsed = F.from_json(json, schema, {"columnNameOfCorruptRecord": "_broken"})
    return F.coalesce(parsed["_broken"].isNotNull() | parsed["response"].isNull(), F.lit(True)) | ~_one_document(json)


def rejected_pages(bodies: DataFrame, json_col: str = "body") -> DataFrame:
    """Landed texts that are no page; all columns stay."""
    return bodies.filter(broken_page(json_col))


def usable_pages(bodies: DataFrame, json_col: str = "body", page_col: str | None = None) -> DataFrame:
    """Parsed pages of the landed texts: broken and failed ones left out, one response for each page number.

    Pages of one file have one number each only where ``page_col`` goes by ``line`` too.
    """
    parsed = parse_pages(bodies.filter(~broken_page(json_col)), json_col).filter(F.coalesce("success", F.lit(True)))
    return parsed if page_col is None else parsed.dropDuplicates([page_col])


def landed_status(bodies: DataFrame, page_col: str, json_col: str = "body") -> DataFrame:
    """(page number, success) of every landed text, as ``missing_pages`` reads it; a broken one has failed."""
    page = F.from_json(json_col, EMPLOYER_PAGE)
    return bodies.select(page_col, (~broken_page(json_col) & F.coalesce(page["success"], F.lit(True))).alias("success"))


def load_employers(spark: SparkSession, path: str) -> DataFrame:
    """Employer table from a folder of landed JSON pages; see ``rejected_pages`` for the texts left out."""
    return project_employers(explode_employers(usable_pages(landed_bodies(spark, path))))


def missing_pages(landed: DataFrame, total: int, page_col: str = "page_num", max_tries: int = MAX_TRIES) -> DataFrame:
    """Pages 1..total without a successful response.

    ``tries`` counts the failed responses; ``retry`` is false once a page has used
    up its tries.
    """
    expected = landed.sparkSession.range(1, total + 1).select(F.col("id").alias(page_col))
    seen = landed.groupBy(F.col(page_col).cast("long").alias(page_col)).agg(
        F.count(F.lit(1)).alias("seen"), F.max(F.coalesce("success", F.lit(False))).alias("done")
    )
    tries = F.coalesce("seen", F.lit(0))
    return (
        expected.join(seen, page_col, "left")
        .filter(~F.coalesce("done", F.lit(False)))
        .select(page_col, tries.alias("tries"), (tries < max_tries).alias("retry"))
    )


def announced_pages(pages: DataFrame) -> int:
    """Number of pages the landed responses say there are."""
    return pages.agg(F.coalesce(F.max("response.totalNumberOfPages"), F.lit(0))).first()[0]
