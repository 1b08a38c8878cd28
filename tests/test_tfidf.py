import math
import random
from collections import Counter

import pytest

import reviewloom as rl


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(words, weights=range(12, 0, -1), k=rng.randint(3, 25))) for _ in range(60)]
    texts = [t + " all" for t in texts] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, lemmatized_text string").cache()
    return df, [t or "" for t in texts]


def by_hand(texts, low, high, kind="smooth", normalize=True):
    counts = [Counter(t.split()) for t in texts]
    df = Counter(w for c in counts for w in c)
    n = len(texts)
    idf = {w: math.log((1 + n) / (1 + d)) + 1 if kind == "smooth" else math.log(n / d) for w, d in df.items() if low <= d <= high}
    out = {}
    for i, c in enumerate(counts):
        row = {w: tf * idf[w] for w, tf in c.items() if w in idf}
        length = math.sqrt(sum(v * v for v in row.values())) if normalize else 1.0
        out.update({(i, w): v / length for w, v in row.items()})
    return df, out


def weights(result):
    return {(r.doc_id, r.term): r.tfidf for r in result.matrix.collect()}


@pytest.mark.parametrize("kind, normalize", [("smooth", True), ("plain", False)])
def test_weights_match_a_plain_computation(docs, kind, normalize):
    df, texts = docs
    result = rl.tfidf(df, min_df=20, max_df=0.9, idf_kind=kind, normalize=normalize)
    _, expected = by_hand(texts, 20, 0.9 * len(texts), kind, normalize)
    assert weights(result) == pytest.approx(expected)
    assert not any(term == "all" for _, term in weights(result))  # in 60 of 62 documents
    result.unpersist()


def test_limits_are_inclusive_and_terms_are_numbered_in_order(docs):
    df, texts = docs
    counts, _ = by_hand(texts, 0, 99)
    low = sorted(counts.values())[4]
    result = rl.tfidf(df, min_df=low, max_df=60)
    kept = sorted(t for t, d in counts.items() if low <= d <= 60)
    rows = result.vocabulary.orderBy("term_idx").collect()
    assert [r.term for r in rows] == kept and [r.term_idx for r in rows] == list(range(len(kept)))
    assert "all" in kept and low in {r.df for r in rows}
    result.unpersist()


def test_most_frequent_terms_only(docs):
    df, texts = docs
    total = Counter(w for t in texts for w in t.split())
    best = sorted(total, key=lambda w: (-total[w], w))[:5]
    result = rl.tfidf(df, min_df=1, max_df=1.0, max_features=5)
    assert [r.term for r in result.vocabulary.orderBy("term_idx").collect()] == sorted(best)
    result.unpersist()


def test_bigrams(spark):
    df = spark.createDataFrame([(1, "aa bb aa bb"), (2, "bb aa"), (3, "cc")], "doc_id long, lemmatized_text string")
    result = rl.tfidf(df, min_df=1, max_df=1.0, ngram=2, normalize=False)
    assert {(r.doc_id, r.term, r.tf) for r in result.matrix.collect()} == {(1, "aa bb", 2), (1, "bb aa", 1), (2, "bb aa", 1)}
    result.unpersist()


def test_weighting_moves_the_texts_once(docs):
    df, _ = docs
    result = rl.tfidf(df, min_df=1, max_df=1.0)
    result.counts.count()
    # above the kept counts: broadcast join and window, no exchange of the counts
    plan = result.matrix._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert "BroadcastHashJoin" in plan and "Window" in plan and "Exchange hashpartitioning" not in plan
    result.unpersist()


def test_partitions_of_counts_grow_with_the_documents(spark, monkeypatch):
    from reviewloom.operators.tfidf import term_counts

    monkeypatch.setattr("reviewloom.operators.tfidf.DOCS_PER_TASK", 3)
    docs = spark.createDataFrame([(i, "ab cd ab") for i in range(60)] + [(0, "cd")], "doc_id long, lemmatized_text string")
    counts = term_counts(docs)
    assert counts.rdd.getNumPartitions() == 21
    rows = {(r.doc_id, r.term): r.tf for r in counts.collect()}
    assert len(rows) == 120 and rows[0, "ab"] == 2 and rows[0, "cd"] == 2 and rows[59, "cd"] == 1
