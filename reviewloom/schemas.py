"""Table schemas. Every column is nullable: a missing source key becomes NULL."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()

RATING_COLUMNS = (
    "overall_rating",
    "culture_rating",
    "comp_rating",
    "opportunity_rating",
    "leader_rating",
    "work_life_rating",
)

# column of the employer table -> key of the source document (fixed values)
EMPLOYER_KEYS = {
    "company_id": "id",
    "company_name": "name",
    "num_ratings": "numberOfRatings",
    "overall_rating": "overallRating",
    "recommend_pct": "recommendToFriendRating",
    "culture_rating": "cultureAndValuesRating",
    "comp_rating": "compensationAndBenefitsRating",
    "opportunity_rating": "careerOpportunitiesRating",
    "leader_rating": "seniorLeadershipRating",
    "work_life_rating": "workLifeBalanceRating",
    "industry": "industryName",
}

EMPLOYERS = T.StructType(
    [
        T.StructField(
            name,
            T.LongType()
            if name == "company_id"
            else T.IntegerType()
            if name == "num_ratings"
            else T.DoubleType()
            if name in RATING_COLUMNS
            else _S,
        )
        for name in EMPLOYER_KEYS
    ]
)

REVIEWS = T.StructType(
    [
        T.StructField("company_id", T.LongType()),
        T.StructField("company_name", _S),
        T.StructField("pro_or_con", _S),
        T.StructField("review_text", _S),
    ]
)

WORK_LIST = T.StructType([T.StructField("company_name", _S), T.StructField("company_id", T.LongType())])

# One result page of the employer listing. Leaves are read as text and cast
# afterwards, so numbers and quoted numbers are both accepted.
EMPLOYER_PAGE = T.StructType(
    [
        T.StructField("success", T.BooleanType()),
        T.StructField(
            "response",
            T.StructType(
                [
                    T.StructField("totalNumberOfPages", T.IntegerType()),
                    T.StructField(
                        "employers",
                        T.ArrayType(T.StructType([T.StructField(key, _S) for key in EMPLOYER_KEYS.values()])),
                    ),
                ]
            ),
        ),
    ]
)
