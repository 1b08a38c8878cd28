"""Selection of employers by the tails of their ratings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.ranking import exact_quantiles, global_rank

MIN_RATINGS = 100
TAIL = 0.05
BATCH_SIZE = 6


def min_count(df: DataFrame, min_ratings: int = MIN_RATINGS) -> DataFrame:
    return df.filter(F.col("num_ratings") >= min_ratings)


def _clean_rating(df: DataFrame) -> DataFrame:
    """Ratings with NaN turned into NULL: NaN would compare as the largest number."""
    return df.withColumn("overall_rating", F.when(~F.isnan("overall_rating"), F.col("overall_rating")))


def cutoffs(df: DataFrame, tail: float = TAIL) -> DataFrame:
    """One row (low, high): the tail quantiles of the rating, rounded to one decimal."""
    low, high = exact_quantiles(_clean_rating(df), "overall_rating", [tail, 1 - tail])
    exact = df.sparkSession.createDataFrame([(low, high)], "low double, high double")
    return exact.select(F.round("low", 1).alias("low"), F.round("high", 1).alias("high"))


@dataclass(frozen=True)
class Segments:
    """Employers with enough ratings, and the masks of their two tails."""

    employers: DataFrame
    low: Column
    high: Column

    @property
    def tails(self) -> DataFrame:
        return self.employers.filter(self.low | self.high)

    @property
    def middle(self) -> DataFrame:
        """Neither low nor high; employers without a rating belong here."""
        return self.employers.filter(~F.coalesce(self.low, F.lit(False)) & ~F.coalesce(self.high, F.lit(False)))


def segment(df: DataFrame, min_ratings: int = MIN_RATINGS, tail: float = TAIL) -> Segments:
    """Split at the rounded cut-offs; both tails include their cut-off.

    The cut-offs are computed here, so that the masks compare with plain numbers.
    """
    employers = _clean_rating(min_count(df, min_ratings))
    low, high = cutoffs(employers, tail).first()
    rating = F.col("overall_rating")
    return Segments(employers, rating <= F.lit(low), rating >= F.lit(high))


def select_tails(df: DataFrame, min_ratings: int = MIN_RATINGS, tail: float = TAIL) -> DataFrame:
    return segment(df, min_ratings, tail).tails


def select_middle(df: DataFrame, min_ratings: int = MIN_RATINGS, tail: float = TAIL) -> DataFrame:
    return segment(df, min_ratings, tail).middle


def split_by_mean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): ratings from the mean up and from the mean down; the mean is in both."""
    df = _clean_rating(df)
    mean = F.lit(df.agg(F.avg("overall_rating")).first()[0])
    return df.filter(F.col("overall_rating") >= mean), df.filter(F.col("overall_rating") <= mean)


def work_list(df: DataFrame) -> DataFrame:
    return df.select("company_name", "company_id")


def work_order(df: DataFrame) -> DataFrame:
    """Smallest employers first, ties by id."""
    return df.orderBy("num_ratings", "company_id")


def work_batches(df: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Pairs of the work order with their position and their batch of ``size``."""
    ranked = global_rank(df, [F.col("num_ratings"), F.col("company_id")], "position")
    return ranked.select(
        "company_name", "company_id", "position", F.floor(F.col("position") / size).cast("long").alias("batch")
    )
