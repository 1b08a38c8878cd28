import tracemalloc
import weakref
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import toxicity as T
from reviewloom.llm.quality import drop_poor, rate_documents
from reviewloom.llm.toxicity import Index, drop_toxic, score_documents

from .conftest import DATA


def auc(scores, labels):
    ones, zeros = scores[labels == 1], scores[labels == 0]
    return np.mean([(one > zeros).mean() + 0.5 * (one == zeros).mean() for one in ones])


@pytest.mark.skipif(not DATA.exists(), reason="benchmark tables are not here")
def test_held_out_accuracy(spark):
    folder = DATA.parent / "sf0.1"
    docs, labels = (spark.read.parquet(str(folder / f"{t}.parquet")) for t in ("documents", "labels"))
    known = {r.doc_id: r for r in labels.collect()}
    out = {i for i in known if zlib.crc32(str(i).encode()) % 5 == 0}
    scored = [r for r in score_documents(docs, labels).collect() if r.doc_id in out]
    assert all(r.held_out and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert auc(np.array([r.score for r in scored]), np.array([known[r.doc_id].toxic for r in scored])) > 0.95
    rated = [r for r in rate_documents(docs, labels).collect() if r.doc_id in out]
    assert auc(np.array([r["__quality"] for r in rated]), np.array([known[r.doc_id].quality for r in rated])) > 0.99


def test_search_is_exact():
    draw = np.random.default_rng(0)
    index = Index([f"t{i}" for i in range(30)], [5] * 30, 100)
    examples = [(i, i % 2, {int(t): int(draw.integers(1, 5)) for t in draw.choice(31, 4, replace=False)}) for i in range(500)]
    index.build(examples)
    dense = np.zeros((500, 31))
    place = {i: row for row, i in enumerate(index.ids)}
    for i, _, counts in examples:
        terms, weights = index.vector(counts)
        dense[place[i], terms] = weights
    for _, _, counts in examples[:60]:
        terms, weights = index.vector(counts)
        rows, cosines = index.nearest(terms, weights, 15)
        wanted = dense[:, terms] @ weights
        assert np.allclose(np.sort(wanted)[::-1][:15], cosines) and np.allclose(wanted[rows], cosines)


@pytest.mark.skipif(not DATA.exists(), reason="benchmark tables are not here")
def test_search_over_blocks_is_exact(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 8)
    folder = DATA.parent / "sf0.01"
    docs, labels = (spark.read.parquet(str(folder / f"{t}.parquet")) for t in ("documents", "labels"))
    index = T.fit(docs, labels)
    counter = T.TermCounter(index.terms, index.beginnings)
    every = np.zeros((index.blocks * T.BLOCK, len(index.terms) + 1))
    own = np.repeat(np.arange(len(index.sizes)), index.sizes)
    every[index.rows, own] = index.weights
    assert index.blocks > 2 * T.NEIGHBOURS and np.allclose(np.linalg.norm(every[: len(index.ids)], axis=1), 1)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    index.visited = 0
    index.score([counter.count(text) for text in texts.values()])
    assert index.visited < 0.9 * index.blocks * len(texts)  # blocks are ruled out
    for row in score_documents(docs, labels).collect():
        counts = counter.count(texts[row.doc_id])
        if set(counts) <= {index.other}:
            assert not row.neighbours
            continue
        terms, weights = index.vector(counts)
        wanted = np.round(every[: len(index.ids), terms] @ weights, 12)
        wanted = np.sort(wanted[wanted > index._floor(weights[terms == index.other].sum())])[::-1][: T.NEIGHBOURS]
        assert np.allclose(wanted, row.cosines, atol=1e-9)


def test_sample_is_bounded_in_rows(spark, docs_of):
    docs = docs_of([*((1, f"text {i}") for i in range(50)), *((2, "same") for _ in range(50)), (3, None)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), *((i, 0) for i in range(100, 400))], "doc_id long, toxic int")
    rows = T.labelled_sample(docs, labels, "toxic", "doc_id", "text", 1000).collect()
    assert len(rows) == 52 - 50 * (zlib.crc32(b"1") % 5 == 0) - (zlib.crc32(b"2") % 5 == 0) - (zlib.crc32(b"3") % 5 == 0)
    assert T.labelled_sample(docs, labels, "toxic", "doc_id", "text", 1).count() == 1


def test_rows_of_all_kinds(spark, docs_of, monkeypatch):
    monkeypatch.setattr(T, "LEAST_CHI2", 10.0)
    texts = [("you idiot scum " if i % 4 == 0 else "a fine day ") + f"word{i} " * 3 for i in range(200)]
    rows = [*enumerate(texts), (500, None), (501, ""), (None, "idiot"), (502, "idiot scum " * 30_000), (502, "again")]
    docs = docs_of(rows)
    labels = spark.createDataFrame(
        [*((i, int(i % 2 == 0), int(i % 4 == 0)) for i in range(200)), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"
    )
    found = score_documents(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    assert by_id[None].predicted == 1 and not by_id[None].held_out and by_id[500].score == by_id[501].score < 0.5
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {500, 501, 1, 2, 3}
    rated = rate_documents(docs, labels)
    assert rated.count() == len(rows) and all(0 <= r["__quality"] <= 1 for r in rated.collect())
    none = labels.filter("false")
    assert drop_poor(docs, none).count() == len(rows) and drop_toxic(docs, none).count() == len(rows)
    empty = docs_of([])
    assert drop_poor(empty, labels).count() == 0 and drop_toxic(empty, labels).count() == 0


def test_sparse_sites_are_drawn_to_the_prior(spark):
    from reviewloom.llm.quality import site_priors

    rows = [("a", "p", 1.0)] * 500 + [("b", "p", 0.2)] * 500 + [("c", "q", 0.2)] + [(None, None, 0.5)]
    sites, share, worth = site_priors(spark.createDataFrame(rows, "host string, path string, p double"), "host", "path", "p")
    prior = {round(r.total): r.host_prior for r in sites.collect()}
    assert prior[500] > 0.97 and prior[100] < 0.23 and 0.2 < prior[0] < share + 0.05


def test_texts_without_telling_terms_are_searched(spark, docs_of):
    # alpha and beta are in texts with label 0 only: an index of terms that tell label 1 leaves them out
    texts = [f"alpha{i % 20} beta{i % 20}" if i % 4 else f"gamma{i % 40} delta{i % 40}" for i in range(60)]
    docs = docs_of([*enumerate(texts), (900, "gamma4 delta4"), (901, "alpha1 beta1")])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    assert found[900].neighbours and found[901].neighbours
    assert found[900].score > found[901].score


@pytest.mark.skipif(not DATA.exists(), reason="benchmark tables are not here")
def test_every_text_with_a_known_word_has_neighbours(spark):
    docs, labels = (spark.read.parquet(str(DATA / f"{t}.parquet")) for t in ("documents", "labels"))
    index = T.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    counter = T.TermCounter(index.terms, index.beginnings)
    known = {i for i, text in texts.items() if set(counter.count(text)) - {index.other}}
    found = {r.doc_id: r.neighbours for r in score_documents(docs, labels).collect()}
    assert len(known) > 100 and all(found[i] for i in known)


def test_sites_with_nulls_are_sites_of_their_own(spark):
    """Rates are those of the same table with names in place of the NULLs."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    by = F.col("doc_id") % 4
    docs = docs.withColumn("source", F.when(by != 1, F.lit("en"))).withColumn("lang", F.when(by != 2, F.lit("en")))
    docs = docs.withColumn("source", F.when(by != 3, F.col("source")))
    named = docs.fillna({"source": "no source", "lang": "no lang"})
    rates = [{r.doc_id: (r.site, r.q) for r in rate(each, labels)} for each in (docs, named)]
    assert rates[0].keys() == rates[1].keys()
    assert all(np.allclose(rates[0][i], rates[1][i], atol=1e-12) for i in rates[0])


def rate(docs, labels):
    return rate_documents(docs, labels).select("doc_id", F.col("__site").alias("site"), F.col("__quality").alias("q")).collect()


def test_terms_are_counted_in_many_texts_at_once(monkeypatch):
    texts = ["Idiot idiotic, day", "", "a\x1fday Day\nday3day", "ΟΔΟΣ. İdle _ 42", "idiotic " * 70, "new words idiot's"] * 3
    words = sorted({t for text in texts[:5] for token in text.split() for t in T.terms_of(token)}, key=T._digest)
    beginnings = [t for t in words if t[-1] == "-"]
    terms = np.array([T._digest(t) for t in words])
    for most, at_once in ((T.REMEMBERED, T.CHARS_AT_ONCE), (2, 30)):
        monkeypatch.setattr(T, "REMEMBERED", most)
        monkeypatch.setattr(T, "CHARS_AT_ONCE", at_once)
        rows, found, tf = T.TermCounter(terms, beginnings).count_all(texts)
        assert (np.lexsort((found, rows)) == np.arange(len(rows))).all()
        for i, text in enumerate(texts):
            wanted = Counter()
            for token in text.split():
                wanted.update([words.index(t) for t in T.terms_of(token) if t in words] or [len(words)])
            assert dict(zip(found[rows == i].tolist(), tf[rows == i].tolist())) == wanted
            assert T.TermCounter(terms, beginnings).count(text) == wanted


def test_scores_from_counts_side_by_side_are_those_of_each_text():
    draw = np.random.default_rng(1)
    index = Index([f"t{i}" for i in range(300)], [5] * 300, 700)
    index.build([(i, i % 3 == 0, {int(t): int(draw.integers(1, 4)) for t in draw.choice(301, 9, replace=False)}) for i in range(700)])
    index.calibrate()
    counts = [{int(t): int(draw.integers(1, 4)) for t in sorted(draw.choice(301, n % 12, replace=False))} for n in range(150)]
    counts[20] = {index.other: 3}
    rows = np.repeat(np.arange(150), [len(c) for c in counts])
    terms, tf = (np.array([pair[j] for c in counts for pair in c.items()]) for j in (0, 1))
    together = index.score_counts(150, rows, terms, tf)
    assert together == [index.score([c])[0] for c in counts] and together[20][1] == together[0][1] == []


def test_building_an_index_takes_little_beyond_its_postings():
    draw = np.random.default_rng(2)
    sizes = np.full(2000, 200)
    terms = np.concatenate([np.sort(draw.choice(3000, 200, replace=False)) for _ in sizes]).astype(np.int32)
    tf = draw.integers(1, 4, len(terms)).astype(np.int32)
    index = Index(np.arange(3000), [133] * 3000, 2000)
    tracemalloc.start()
    index.build_flat(np.arange(2000), np.zeros(2000), sizes, terms, tf)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 40 * len(terms) and held < 8 * len(terms)  # bytes


def test_features_reach_the_driver_as_columns(spark, docs_of, monkeypatch):
    from reviewloom.llm import quality

    docs = docs_of([(i, f"text {'good and long ' * (i % 2 * 9)} {i}") for i in range(60)] + [(90, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    refused = property(lambda self: (_ for _ in ()).throw(AssertionError("rows as objects")))
    with monkeypatch.context() as patch:
        patch.setattr(type(docs), "collect", refused)
        model = quality.fit(docs, labels)
        assert quality.fit(docs, labels.filter("quality = 1")) is None and quality.fit(docs, labels.filter("false")) is None
    scores = model.scores(np.array([quality.surface(f"text {'good and long ' * (i % 2 * 9)} {i}") for i in range(60)]))
    assert scores[1::2].min() > scores[::2].max()


def test_driver_gives_the_index_back(spark, docs_of, monkeypatch):
    made, alive = [], []
    fit = T.fit

    def noted(*args, **names):
        index = fit(*args, **names)
        made.append(weakref.ref(index))
        return index

    monkeypatch.setattr(T, "fit", noted)
    monkeypatch.setattr(T, "give_back", lambda: alive.append([index() is not None for index in made]), raising=False)
    docs = docs_of([(i, f"{'vile' if i % 2 else 'kind'} word{i % 7} here") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    for run in (drop_toxic, score_documents):
        made.clear()
        alive.clear()
        run(docs, labels)
        assert alive and alive[-1] == [False]
