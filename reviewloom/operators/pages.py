"""Review pages: what to fetch, and the reviews inside what was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.markup import blocks, clean_markup, first_element_text, nth_paragraph
from reviewloom.functions.text import leading_count, url_slug
from reviewloom.operators.rows import explode_rows

# Fixed values of the page layout
BLOCKED_TITLE = "Pardon Our Interruption..."
BLOCK_TAG = "div"
BLOCK_CLASS = "cell reviewBodyCell"
PRO_PARAGRAPH = 2
CON_PARAGRAPH = 4

URL_TEMPLATE = (
    "https://reviews.example.com/Reviews/%s-Reviews-E%s%s.htm"
    "?filter.defaultEmploymentStatuses=false&filter.defaultLocation=false&filter.resetFilters=true"
)


def page_count(total: Column, page_size: Column) -> Column:
    """Whole pages plus one, also when the total is a multiple of the page size; NULL for size 0."""
    return F.floor(F.try_divide(total, page_size)).cast("int") + 1


def page_url(name: Column, company_id: Column, page: Column, template: str = URL_TEMPLATE) -> Column:
    """Address of a page; only pages after the first carry their number."""
    suffix = F.when(page == 1, F.lit("")).otherwise(F.format_string("_P%d", page))
    return F.format_string(template, url_slug(name), company_id.cast("string"), suffix)


def page_plan(employers: DataFrame, template: str = URL_TEMPLATE) -> DataFrame:
    """One row per page to fetch, from (company_id, company_name, num_ratings, page_size)."""
    pages = page_count(F.col("num_ratings"), F.col("page_size"))
    return (
        employers.select("company_id", "company_name", F.explode(F.sequence(F.lit(1), pages)).alias("page"))
        .withColumn("url", page_url(F.col("company_name"), F.col("company_id"), F.col("page"), template))
    )


def page_facts(pages: DataFrame, tag: str = BLOCK_TAG, css_class: str | None = BLOCK_CLASS) -> DataFrame:
    """Per first page: the review total of its heading and the number of reviews on it.

    A heading inside a comment, script or style sheet does not count.
    """
    clean = pages.withColumn("_clean", clean_markup(F.col("html")))
    return clean.withColumns(
        {
            "num_ratings": leading_count(first_element_text(F.col("_clean"), "h2")),
            "page_size": F.size(blocks(F.col("_clean"), tag, css_class)),
        }
    ).drop("_clean")


def flag_blocked(pages: DataFrame, title: str = BLOCKED_TITLE) -> DataFrame:
    """Adds ``blocked``: the first heading that shows is that of the interstitial page."""
    heading = first_element_text(clean_markup(F.col("html")), "h1")
    return pages.withColumn("blocked", F.coalesce(heading == title, F.lit(False)))


def extract_reviews(
    pages: DataFrame,
    tag: str = BLOCK_TAG,
    css_class: str | None = BLOCK_CLASS,
    pro_paragraph: int = PRO_PARAGRAPH,
    con_paragraph: int = CON_PARAGRAPH,
) -> DataFrame:
    """One review per block of every page (company_id, company_name, pro_or_con, html).

    The paragraph taken depends on the polarity the page was fetched for. A block
    with too few paragraphs gives a NULL text. Nothing is shuffled.
    """
    index = F.when(F.col("pro_or_con") == "pro", pro_paragraph).otherwise(con_paragraph)
    # a column of its own: the cleaned page is read more than once
    clean = pages.withColumn("html", clean_markup(F.col("html")))
    found = explode_rows(
        clean, blocks(F.col("html"), tag, css_class), "block", "company_id", "company_name", "pro_or_con"
    )
    return found.select(
        "company_id", "company_name", "pro_or_con", nth_paragraph(F.col("block"), index).alias("review_text")
    )
