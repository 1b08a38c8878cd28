import pytest
from pyspark.sql import functions as F

import reviewloom as rl
from reviewloom.functions.markup import blocks, decode_entities, element_text, first_element_text, nth_paragraph
from reviewloom.functions.text import ascii_fold, leading_count, safe_name, url_slug


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text, plain",
    [
        ("a &amp; b", "a & b"),
        ("&amp;copy;", "&copy;"),
        ("&#233;t&#xe9; &copy;", "été ©"),
        ("&#128512;", "😀"),
        ("&unknown; &amp", "&unknown; &amp"),
        ("&#0;&#xD800;&#9999999;", "&#0;&#xD800;&#9999999;"),
        ("a&&lt;b&gt;", "a&<b>"),
        ("&apos;&quot;", "'\""),
        ("plain", "plain"),
        (None, None),
    ],
)
def test_character_references(spark, text, plain):
    assert one(spark, text, decode_entities) == plain


BLOCK = '<div class="cell reviewBodyCell"><div><p>0</p></div><p>1<p class="x">t&amp;<b>wo</b></p><p>3</p>%s</div>'
PAGE = (
    "<h1>Title</h1><h2> 1,234 Reviews</h2><!-- <div class='cell reviewBodyCell'> -->"
    + BLOCK % "<p>4</p>"
    + '<div class="cell">no</div><div class="other cell reviewBodyCell">no</div>'
    + BLOCK % ""
    + "<p>outside</p>"
)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "a", "pro", PAGE), (2, "b", "con", PAGE), (3, "c", "pro", "<h1>Pardon Our Interruption...</h1>")]
    return spark.createDataFrame(rows, "company_id long, company_name string, pro_or_con string, html string")


def test_reviews_of_a_page(pages):
    rows = rl.extract_reviews(pages).orderBy("company_id", "review_text").collect()
    assert [(r.company_id, r.pro_or_con, r.review_text) for r in rows] == [
        (1, "pro", "t&wo"), (1, "pro", "t&wo"), (2, "con", None), (2, "con", "4"),
    ]


def test_blocked_and_facts(pages):
    assert {r.company_id: r.blocked for r in rl.flag_blocked(pages).collect()} == {1: False, 2: False, 3: True}
    facts = {r.company_id: (r.num_ratings, r.page_size) for r in rl.page_facts(pages).collect()}
    assert facts == {1: (1234, 2), 2: (1234, 2), 3: (None, 0)}


def test_blocks_end_where_their_element_closes(spark):
    html = "<div class='c'>a<div>b</div>c</div>d<div class='c'>e"
    assert one(spark, html, lambda c: blocks(c, "div", "c")) == ["a<div>b</div>c", "e"]
    assert one(spark, "none", lambda c: blocks(c, "div", "c")) == []


def test_paragraphs_and_headings(spark):
    assert one(spark, "<p>a<p>b</p>", lambda c: nth_paragraph(c, 0)) == "a"
    assert one(spark, "<p>a<p>b</p>", lambda c: nth_paragraph(c, 5)) is None
    assert one(spark, "<pre>x</pre><P id=1>y</P>", lambda c: nth_paragraph(c, 0)) == "y"
    assert one(spark, "<h1 a='b'>x <i>y</i></h1>", lambda c: first_element_text(c, "h1")) == "x y"
    assert one(spark, "<b>x</b>&lt;", element_text) == "x<"


@pytest.mark.parametrize("text, n", [("1,234 Reviews", 1234), (" 7\n", 7), ("none here", None), ("", None), (None, None)])
def test_leading_count(spark, text, n):
    assert one(spark, text, leading_count) == n


def test_slugs(spark):
    assert one(spark, "Crédit Straße Łódź", url_slug) == "Credit-Strasse-Lodz"
    assert one(spark, "Œuvre “é”", ascii_fold) == 'OEuvre "e"'
    assert one(spark, "Top Words", lambda c: safe_name([c, " 1.png"])) == "top_words_1.png"


def test_page_plan(spark):
    rows = [(1, "A B", 20, 10), (2, "C", 9, 10), (3, "D", 5, 0)]
    df = spark.createDataFrame(rows, "company_id long, company_name string, num_ratings int, page_size int")
    plan = rl.page_plan(df, "u/%s/%s%s").orderBy("company_id", "page").collect()
    # a multiple of the page size plans one page more; page size 0 plans none
    assert [(r.company_id, r.url) for r in plan] == [(1, "u/A-B/1"), (1, "u/A-B/1_P2"), (1, "u/A-B/1_P3"), (2, "u/C/2")]


def test_headings_that_do_not_show(spark):
    hidden = "<!-- <h1>Pardon Our Interruption...</h1><h2>9 Reviews</h2> --><script>var a='<h2>8 x</h2>'</script>"
    df = spark.createDataFrame([(1, hidden + "<h1>Real</h1><h2>1,234 Reviews</h2>")], "company_id long, html string")
    row = rl.page_facts(rl.flag_blocked(df)).first()
    assert not row.blocked and row.num_ratings == 1234


def test_references_of_any_length(spark):
    text = "&#0000000065;&#x00000042;&#99999999999;&#x110000;&#xFFFFFFFFFFFFFFFFFF;"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(decode_entities(F.col("t")).alias("t")).first().t == "AB" + text[text.index("&#999") :]
