import json

from pyspark.sql import functions as F

import reviewloom as rl
from reviewloom import sources
from reviewloom.schemas import EMPLOYER_PAGE, EMPLOYERS, REVIEWS


def page(employers, success=True):
    return json.dumps({"success": success, "response": {"totalNumberOfPages": 3, "employers": employers}})


def test_employers_from_landed_pages(spark, tmp_path):
    landed = tmp_path / "pages"
    landed.mkdir()
    (landed / "1.json").write_text(
        page(
            [
                {"id": 1, "name": "A", "numberOfRatings": 120, "overallRating": "4.4", "other": 5},
                {"id": "2", "name": "B", "numberOfRatings": "7", "overallRating": "NaN", "industryName": "x"},
            ]
        )
    )
    (landed / "2.json").write_text(json.dumps({"success": False}))
    df = rl.load_employers(spark, str(landed))
    assert df.schema == EMPLOYERS
    rows = {r.company_id: r for r in df.collect()}
    assert rows[1].overall_rating == 4.4 and rows[1].num_ratings == 120 and rows[1].industry is None
    assert rows[2].overall_rating is None and rows[2].industry == "x"


def test_spread_out_broken_and_repeated_pages(spark, tmp_path):
    one = page([{"id": 1, "name": "A", "numberOfRatings": 5}])
    for name, body in {
        "1.json": json.dumps(json.loads(one), indent=2), "2.json": one, "2b.json": one, "3.json": one[:-9], "4.json": "",
        "5.json": page([{"id": 9, "name": "Z", "numberOfRatings": 1}], success=False), "6.json": "[]",
    }.items():
        (tmp_path / name).write_text(body)
    assert sorted(r.company_id for r in rl.load_employers(spark, str(tmp_path)).collect()) == [1, 1]
    bodies = sources.landed_bodies(spark, str(tmp_path))
    rejected = sorted(r.file.rsplit("/", 1)[1] for r in sources.rejected_pages(bodies).collect())
    assert rejected == ["3.json", "6.json"]
    numbered = bodies.withColumn("page_num", F.regexp_extract("file", r"(\d)b?\.json", 1).cast("int"))
    assert sources.usable_pages(numbered, page_col="page_num").count() == 2
    again = numbered.unionByName(numbered)
    assert sources.explode_employers(sources.usable_pages(again, page_col="page_num")).count() == 2
    missing = rl.missing_pages(sources.landed_status(numbered, "page_num"), 7).collect()
    assert sorted(r.page_num for r in missing) == [3, 4, 5, 6, 7]


def test_files_of_several_pages_and_text_behind_a_page(spark, tmp_path):
    def of(i):
        return page([{"id": i, "name": "A", "numberOfRatings": 5}])

    spread = json.dumps(json.loads(of(8)), indent=2)
    for name, body in {
        "1.json": of(1) + "\n" + of(2) + "\n", "2.json": of(3) + "\r\n\r\n" + of(4)[:-9] + "\r\n" + of(5), "3.json": of(6) + " junk",
        "4.json": of(7) + "] junk", "5.json": spread + "\n", "6.json": spread.replace("8", "9") + spread.replace("8", "10"),
        "7.json": of(11) + of(12), "8.json": of(13)[:-9] + "\n" + of(14),
    }.items():
        (tmp_path / name).write_bytes(body.encode())
    assert sorted(r.company_id for r in rl.load_employers(spark, str(tmp_path)).collect()) == [1, 2, 3, 5, 8, 14]
    rejected = sources.rejected_pages(sources.landed_bodies(spark, str(tmp_path)))
    found = sorted((r.file.rsplit("/", 1)[1], r.line) for r in rejected.collect())
    assert found == [("2.json", 2), ("3.json", 1), ("4.json", 1), ("6.json", 1), ("7.json", 1), ("8.json", 1)]


def test_bad_ids_are_reported_not_raised(spark):
    body = page([{"id": "x", "numberOfRatings": 1}, {"id": 3, "numberOfRatings": 4}])
    documents = sources.explode_employers(sources.parse_pages(spark.createDataFrame([(body,)], "body string")))
    assert [r.id for r in sources.rejected_employers(documents).collect()] == ["x"]
    assert {r.company_id for r in sources.project_employers(documents).collect()} == {None, 3}


def test_missing_pages(spark):
    landed = spark.createDataFrame([(1, True), (2, False), (2, True), *[(3, False)] * 5, (4, False)], "page_num int, success boolean")
    rows = {(r.page_num, r.tries, r.retry) for r in rl.missing_pages(landed, 6).collect()}
    assert rows == {(3, 5, False), (4, 1, True), (5, 0, True), (6, 0, True)}


def test_announced_pages(spark):
    pages = sources.parse_pages(spark.createDataFrame([(page([]),), ('{"success": false}',)], "body string"))
    assert sources.announced_pages(pages) == 3
    assert sources.announced_pages(pages.limit(0)) == 0


def test_tables_shards_and_appends(spark, tmp_path):
    a, b, gone = (str(tmp_path / n) for n in ("a", "b", "gone"))
    one = spark.createDataFrame([(1, "n", "pro", "t")], REVIEWS)
    sources.write_table(one, a)
    sources.write_table(one.drop("pro_or_con"), b)
    sources.append_rows(one, a)
    assert sources.read_table(spark, a, REVIEWS).count() == 2
    both = sources.read_shards(spark, [a, b], optional=[gone])
    assert both.count() == 3 and both.filter("pro_or_con is null").count() == 1
    assert sources.read_shards(spark, [a], optional=[b]).count() == 3


def test_partitioned_write_is_pruned_by_polarity(spark, tmp_path):
    df = spark.createDataFrame([(1, "n", "pro", "t"), (1, "n", "con", "u")], REVIEWS)
    sources.write_table(df, str(tmp_path / "p"), ["pro_or_con"])
    pro = sources.read_table(spark, str(tmp_path / "p")).filter("pro_or_con = 'pro'")
    assert "PartitionFilters: [isnotnull(pro_or_con" in pro._jdf.queryExecution().toString()
    assert pro.count() == 1


def test_work_list_round_trip(spark, tmp_path):
    work = spark.createDataFrame([("a", 1, 9)], "company_name string, company_id long, extra int")
    sources.write_work_list(work, str(tmp_path / "w"))
    assert sources.read_work_list(spark, str(tmp_path / "w")).collect() == [("a", 1)]


def test_documents_and_empty_tables(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"company_id": "7", "review_text": "x", "_id": "z"}\n{"pro_or_con": "pro"}\n')
    raw = spark.read.json(str(tmp_path / "d.json"))
    rows = sources.project_reviews(raw).orderBy("company_id").collect()
    assert [tuple(r) for r in rows] == [(None, None, "pro", None), (7, None, None, "x")]
    typed = sources.read_documents(spark, str(tmp_path / "d.json"), REVIEWS)
    assert typed.columns == REVIEWS.fieldNames()
    assert sources.empty_table(spark, EMPLOYERS).count() == 0
    assert EMPLOYER_PAGE["success"].nullable


def test_small_scans_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "s"))
    df = sources.read_spread(spark, str(tmp_path / "s"), "id")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and df.count() == 100
