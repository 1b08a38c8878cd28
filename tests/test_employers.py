import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import reviewloom as rl
from reviewloom.operators.employers import cutoffs
from reviewloom.operators.ranking import with_row_id

SCHEMA = "company_id long, company_name string, num_ratings int, overall_rating double"


@pytest.fixture(scope="module")
def employers(spark):
    rows = [(i, f"e{i}", 100 + i % 7, round(1 + (i % 41) / 10, 1)) for i in range(200)]
    rows += [(900, "unrated", 150, float("nan")), (901, "none", 150, None), (902, "small", 99, 5.0)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def ids(df):
    return {r.company_id for r in df.select("company_id").collect()}


def test_tails_are_inclusive_and_skip_unrated(employers):
    ratings = [round(1 + (i % 41) / 10, 1) for i in range(200)]
    low, high = round(np.quantile(ratings, 0.05), 1), round(np.quantile(ratings, 0.95), 1)
    assert tuple(cutoffs(employers.filter("num_ratings >= 100")).first()) == (low, high)
    expected = {i for i, r in enumerate(ratings) if r <= low or r >= high}
    assert {i for i, r in enumerate(ratings) if r == low} <= expected
    assert ids(rl.select_tails(employers)) == expected
    assert ids(rl.select_middle(employers)) == (set(range(200)) - expected) | {900, 901}


def test_cutoff_rounding_can_admit_more_rows(spark):
    # both quantiles fall between values and are rounded onto one of them
    rows = [(i, "x", 100, r) for i, r in enumerate([2.04] * 5 + [3.0] * 90 + [4.46] * 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = rl.segment(df)
    assert parts.tails.count() + parts.middle.count() == 100


@pytest.mark.parametrize("small", [0, 100_000])
def test_exact_quantiles_match_numpy(spark, small):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [1.5] * 1500 + [float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    clean = [v for v in values if v is not None and not math.isnan(v)]
    quantiles = [0.0, 0.05, 0.333, 0.5, 0.95, 1.0]
    found = rl.exact_quantiles(df, "v", quantiles, buckets=16, small=small)
    assert np.allclose(found, np.quantile(clean, quantiles), atol=1e-12)


def test_quantiles_of_nothing(spark):
    assert rl.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


@pytest.mark.parametrize("per_range", [50, 1_000_000])
def test_global_rank_numbers_in_order(spark, per_range):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcéz中", k=rng.randint(1, 9))) for _ in range(800)}, key=str.encode)
    shuffled = rng.sample(words, len(words))
    df = spark.createDataFrame([(w,) for w in shuffled], "w string")
    ranked = rl.global_rank(df, [F.col("w")], "i", per_range)
    assert {r.w: r.i for r in ranked.collect()} == {w: i for i, w in enumerate(words)}


@pytest.mark.parametrize("per_range", [50, 1_000_000])
def test_global_rank_with_a_hot_major_value_and_nulls(spark, per_range):
    rows = [(100 if i % 3 else i, i) for i in range(1, 600)] + [(100, None), (None, 7), (None, None), (5, None)]
    df = spark.createDataFrame(rows, "n int, id long")
    ranked = rl.global_rank(df, [F.col("n"), F.col("id")], "i", per_range)
    expected = {row: i for i, row in enumerate(sorted(rows, key=lambda r: [(x is not None, x or 0) for x in r]))}
    assert {(r.n, r.id): r.i for r in ranked.collect()} == expected


def test_row_ids_are_dense_and_stable(spark):
    df = spark.createDataFrame([(i % 50, f"t{i}") for i in range(500)], "a int, b string")
    first = {(r.a, r.b): r.doc_id for r in with_row_id(df, per_range=40).collect()}
    second = {(r.a, r.b): r.doc_id for r in with_row_id(df.repartition(7), per_range=90).collect()}
    assert sorted(first.values()) == list(range(500)) and first == second


def test_rating_equal_to_the_mean_is_on_both_sides(spark):
    df = spark.createDataFrame([(1, "a", 1, 2.0), (2, "b", 1, 3.0), (3, "c", 1, 4.0), (4, "d", 1, None)], SCHEMA)
    good, bad = rl.split_by_mean(df)
    assert ids(good) == {2, 3} and ids(bad) == {1, 2}


def test_work_order_and_batches(spark):
    df = spark.createDataFrame([(i, f"e{i}", 50 - i, 3.0) for i in range(13)], SCHEMA)
    assert [r.company_id for r in rl.work_order(df).collect()] == list(range(12, -1, -1))
    batches = {r.company_id: r.batch for r in rl.work_batches(df).collect()}
    assert batches[12] == 0 and batches[7] == 0 and batches[6] == 1 and batches[0] == 2


def test_histogram_matches_numpy(spark):
    values = [round(random.Random(i).uniform(1, 5), 1) for i in range(720)] + [1.0, 5.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    rows = rl.histogram(df, "v").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=723 // 180)
    assert [r.n for r in rows] == list(counts)
    assert np.allclose([r.bin_low for r in rows], edges[:-1]) and rows[-1].bin_high == edges[-1]


def test_histogram_of_one_value_and_of_nothing(spark):
    one = spark.createDataFrame([(2.0,)] * 3, "v double")
    row = rl.histogram(one, "v", 2).orderBy("bin").collect()
    assert [(r.bin_low, r.bin_high, r.n) for r in row] == [(1.5, 2.0, 0), (2.0, 2.5, 3)]
    assert rl.histogram(spark.createDataFrame([], "v double"), "v").count() == 0


def test_segments_keep_their_own_range(spark):
    a = spark.createDataFrame([(0.0,), (10.0,)], "v double")
    b = spark.createDataFrame([(4.0,), (6.0,)], "v double")
    rows = rl.segmented_histogram({"a": a, "b": b}, "v", 2).collect()
    assert {(r.series, r.bin_low, r.bin_high, r.n) for r in rows} == {
        ("a", 0.0, 5.0, 1), ("a", 5.0, 10.0, 1), ("b", 4.0, 5.0, 1), ("b", 5.0, 6.0, 1),
    }
