import reviewloom as rl
from reviewloom.schemas import REVIEWS


def test_junk_and_repeats(spark):
    rows = [(1, "a", "pro", None)] * 2 + [(1, "a", "pro", "x")] * 3 + [(1, "a", "con", "x"), (1, "a", "pro", "Pros"), (1, "a", "pro", "Cons")]
    clean = rl.drop_junk(spark.createDataFrame(rows, REVIEWS)).collect()
    assert sorted(clean, key=str) == sorted(
        [(1, "a", "pro", None), (1, "a", "pro", "x"), (1, "a", "con", "x"), (1, "a", "pro", "Cons")], key=str
    )


def test_smallest_id_of_repeats_is_kept(spark):
    rows = [(5, "x"), (3, "x"), (4, None), (9, None)]
    clean = rl.drop_junk(spark.createDataFrame(rows, "doc_id long, review_text string"), id_col="doc_id")
    assert {tuple(r) for r in clean.collect()} == {(3, "x"), (4, None)}


def coverage(spark, **options):
    targets = spark.createDataFrame(
        [("good", 1, 10, 4.0), ("bad", 2, 10, 2.0), ("mid", 3, 10, 3.5), ("half", 4, 10, 4.0), ("zero", 5, 10, 4.0),
         ("good", 6, 4, 4.0)],
        "company_name string, company_id int, num_ratings int, overall_rating double",
    )
    names = ["good"] * 4 + ["bad"] * 2 + ["mid"] + ["half"] * 5 + [None]
    reviews = spark.createDataFrame([(n, "t") for n in names], "company_name string, review_text string")
    check = rl.coverage_check(targets, reviews)
    return check, *rl.recollect_lists(check, **options)


def test_coverage_edges(spark):
    check, pros, cons = coverage(spark)
    rows = {r.company_id: r for r in check.collect()}
    assert rows[1].ratings_collected == 4 and rows[1].delta_pct == 0.6
    assert rows[6].ratings_collected == 4 and rows[6].delta == 0  # both targets of one name get its count
    assert rows[5].delta is None and rows[4].delta_pct == 0.5
    assert pros.collect() == [("good", 1)] and cons.collect() == [("bad", 2)]


def test_employers_without_reviews_can_be_listed(spark):
    _, pros, _ = coverage(spark, include_zero=True)
    assert {tuple(r) for r in pros.collect()} == {("good", 1), ("zero", 5)}


def test_recollected_rows_are_merged(spark):
    old = spark.createDataFrame([(1, "a", "pro", "x")], REVIEWS)
    new = spark.createDataFrame([(1, "a", "pro", "x"), (1, "a", "pro", "y"), (1, "a", "pro", "Pros")], REVIEWS)
    assert rl.add_recollected(old, None) is old
    assert rl.add_recollected(old, new).count() == 2
    assert rl.add_recollected(old, new.limit(0)).count() == 1


def test_polarity_takes_no_other_rows(spark):
    df = spark.createDataFrame([("pro",), ("con",), ("x",), (None,)], "pro_or_con string")
    assert [part.count() for part in rl.split_polarity(df)] == [1, 1]


def test_reviews_flow_numbers_and_lemmatizes(spark):
    shard = spark.createDataFrame([(1, "a", "pro", "Friendly teams"), (1, "a", "con", "Pros")], REVIEWS)
    rows = rl.build_reviews(shard, shard).collect()
    assert [(r.doc_id, r.lemmatized_text) for r in rows] == [(0, "friendly team")]


def test_row_ids_tell_null_columns_apart(spark):
    rows = [(1, "acme", "pro", None), (1, "acme", None, "pro"), (None, "acme", "pro", None), (2, None, None, None)]
    df = spark.createDataFrame(rows, "n int, a string, b string, c string")
    found = rl.with_row_id(df).collect()
    assert sorted(r.doc_id for r in found) == [0, 1, 2, 3] and {tuple(r)[1:] for r in found} == set(rows)
