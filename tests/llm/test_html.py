import itertools
import math
import time

import numpy as np
import pytest

from reviewloom.llm.html_extract import extract, extract_pages, labelled_nodes, train
from reviewloom.llm.html_layouts import Layout
from reviewloom.llm.html_tree import block_text, decode, parse


@pytest.fixture(scope="module")
def model():
    return train(400)


def test_made_up_pages_not_seen_before(model):
    pages = [Layout(seed).page() for seed in range(9000, 9150)]
    x, y = labelled_nodes(pages)
    assert ((model.scores(x) > 0) == (y > 0)).mean() > 0.98
    same = 0
    for page in pages:
        nodes, pieces = parse(page)
        label = []
        for node in nodes:
            label.append(node.keep == "1" if node.keep is not None else label[node.parent.index] if node.parent else False)
        same += block_text(pieces, label) == extract(model, [page])[0]
    assert same >= 135


def test_text_of_a_page(model):
    body = "".join(f"<p>Sentence number {i}, with a <b>bo</b>ld word &amp; more words to read.</p>" for i in range(6))
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        f"<article><h1>Head &lt;one&gt;</h1>{body}<script>var x='<p>no</p>'</script><p>last  \n line<br>two</article>"
        "<section class=comments><h2>Comments</h2><div class=comment><p>I think so too, really.</p></div></section>"
        "<footer>&copy; me</footer></body></html>"
    )
    line = "Sentence number {}, with a bold word & more words to read."
    wanted = " ".join(["Head <one>", *(line.format(i) for i in range(6)), "last line two"])
    assert extract(model, [page]) == [wanted]
    cut = extract(model, [page[: page.index("last") + 4] + "<a hr"])[0]
    assert cut == wanted.removesuffix(" line two")


def test_decoding_agrees_along_paths():
    nodes, _ = parse("<div><p>a<p>b</div><div><p>c</div>")
    for seed in range(50):
        kept = decode(nodes, np.random.default_rng(seed).normal(size=len(nodes)).tolist())
        for node in nodes:
            path, up = [], node
            while up is not None:
                path.append(kept[up.index])
                up = up.parent
            path.reverse()
            assert "01" not in "".join(str(int(k)) for k in path).lstrip("0")


def test_rows_of_all_kinds(spark, model):
    rows = [(1, "u", None, 0), (None, None, "", 0), (2, "u", "<p>", 0), (2, "u", "<p>", 0), (3, "u", "<div>" * 3000 + "x", 0), (4, "u", "<!-- " + "y" * 500_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = extract_pages(pages, model).collect()
    assert len(found) == 6 and all(r.text is not None for r in found)
    assert extract_pages(pages.filter("false"), model).count() == 0


ARTICLE = "".join(f"<p>Sentence number {i}, with some more words in it to read.</p>" for i in range(8))
READ = " ".join(f"Sentence number {i}, with some more words in it to read." for i in range(8))


@pytest.mark.parametrize(
    "put, wanted",
    [
        ('<script src="a.js"/>alert(1)</script>', READ),
        ("<script src=/js/>alert(1)</script>", READ),
        ("<STYLE media=print/>p{}</STYLE >", READ),
        ("<select><option>a<option>b</select>", READ),
        ("<svg><path d='M0 0'/><text>label</text></svg>", READ),
        ("<select name=x>", READ),
        ("<svg/>", READ),
        ("<template>", READ),
        ("<p>Where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds, it is so.</p>", READ + " Where x=1 holds, it is so."),
        ("<p>And <object data=a>the other</object> words too, as here.</p>", None),
    ],
)
def test_elements_by_the_rules_of_html(model, put, wanted):
    for at in (0, len(ARTICLE)):
        page = f"<html><body><article>{ARTICLE[:at]}{put}{ARTICLE[at:]}</article></body></html>"
        found = extract(model, [page])[0]
        if wanted is None:
            assert "And" in "".join(text or "" for _, text in parse(page)[1]) and "the other" in found
        elif at or wanted == READ:
            assert found == wanted


def test_a_slash_at_the_end_of_a_tag_closes_nothing():
    nodes, pieces = parse("<div data-u=/x/>a<p/>b</div>c")
    assert [(n.tag, n.parent.tag) for n in nodes[1:]] == [("div", "html"), ("p", "div")]
    assert [(nodes[i].tag, text) for i, text in pieces] == [("div", "a"), ("p", "b"), ("html", "c")]


def test_deep_and_long_pages_take_linear_time(model):
    pages = ["<div>" * 100_000 + "x", "<p><button>" + "<div>" * 50_000, "<p>" + "a<b>b</b>" * 100_000, "<ul>" + "<li><select>" * 30_000]
    started = time.monotonic()
    parsed = [parse(page) for page in pages]
    said = block_text(parsed[2][1], [True] * len(parsed[2][0]))
    assert time.monotonic() - started < 15 and said == "ab" * 100_000


def test_decoding_is_best_of_all_labellings():
    """Against every labelling that agrees along its paths, with the cost of opening a region."""
    nodes, _ = parse("<div><p>a<p>b<ul><li>c</ul></div><div><p>d</div>")
    for seed in range(20):
        scores = np.random.default_rng(seed).normal(scale=2, size=len(nodes)).tolist()

        def total(states):
            value = 0.0
            for node, state, score in zip(nodes, states, scores):
                above = states[node.parent.index] if node.parent else "out"
                if (above, state) in (("in", "out"), ("out", "drop"), ("drop", "in"), ("drop", "out")):
                    return -math.inf
                value += -math.log1p(math.exp(-score if state == "in" else score)) - (state == "in" and above == "out")
            return value

        best = max(map(total, itertools.product(("in", "out", "drop"), repeat=len(nodes))))
        kept = decode(nodes, scores)
        states = []
        for node in nodes:
            above = states[node.parent.index] if node.parent else "out"
            states.append("in" if kept[node.index] else "out" if above == "out" else "drop")
        assert total(states) == pytest.approx(best)
