import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

import reviewloom as rl
from reviewloom.functions.vectors import nonnegative_solver
from reviewloom.operators import nmf


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of three planted topics; every tenth mixes two of them."""
    rng = random.Random(7)
    words = [[f"{name}{i}" for i in range(8)] for name in ("red", "green", "blue")]
    rows = []
    for i in range(150):
        topic = i % 3
        text = rng.choices(words[topic], k=15) + (rng.choices(words[(topic + 1) % 3], k=15) if i % 10 == 0 else [])
        rows.append((i, " ".join(text)))
    rows.append((999, ""))
    docs = spark.createDataFrame(rows, "doc_id long, lemmatized_text string").cache()
    weights = rl.tfidf(docs, min_df=2, max_df=1.0)
    settings = rl.NMFSettings(3, max_rounds=30, tol=1e-5)
    return docs, weights, rl.nmf_fit(weights.matrix, weights.vocabulary, settings)


def dense(weights, model):
    n, m, k = 151, weights.vocabulary.count(), model.topics
    x, w, h = np.zeros((n, m)), np.zeros((n, k)), np.zeros((k, m))
    for r in weights.matrix.collect():
        x[min(r.doc_id, 150), r.term_idx] = r.tfidf
    for r in model.w.collect():
        w[min(r.doc_id, 150)] = r.w
    for r in model.h.collect():
        h[:, r.term_idx] = r.h
    return x, w, h


def test_factors_are_not_negative_and_the_objective_falls(corpus):
    _, weights, model = corpus
    x, w, h = dense(weights, model)
    assert (w >= 0).all() and (h >= 0).all()
    steps = model.objectives
    assert len(steps) > 2 and all(b <= a * (1 + 1e-6) for a, b in zip(steps, steps[1:]))


def test_error_equals_the_dense_one(corpus):
    _, weights, model = corpus
    x, w, h = dense(weights, model)
    expected = np.linalg.norm(x - w @ h)
    assert model.errors[-1] == pytest.approx(expected)
    assert rl.reconstruction_error(weights.matrix, model.w, model.h, 3) == pytest.approx(expected)


def test_last_objective_is_the_penalised_error(corpus):
    _, weights, model = corpus
    s = model.settings
    x, _, h = dense(weights, model)
    # the document step for the final H cannot be worse than the one the objective was taken with
    _, w, _ = dense(weights, model)
    value = 0.5 * np.linalg.norm(x - w @ h) ** 2 + s.l1 * (w.sum() + h.sum()) + 0.5 * s.l2 * ((w**2).sum() + (h**2).sum())
    assert value <= model.objectives[-1] * (1 + 1e-6)
    assert value == pytest.approx(model.objectives[-1], rel=1e-2)


def test_planted_topics_are_found(corpus):
    _, _, model = corpus
    tops = rl.top_words(model.h, 8).groupBy("topic").agg(F.collect_set(F.regexp_replace("term", r"\d", "")).alias("s"))
    found = [tuple(r.s) for r in tops.collect()]
    assert sorted(found) == [("blue",), ("green",), ("red",)]


def test_mixed_documents_have_two_labels(corpus):
    _, _, model = corpus
    counts = {r.doc_id: r["count"] for r in rl.topic_labels(model.w).groupBy("doc_id").count().collect()}
    assert all(counts[i] == (2 if i % 10 == 0 else 1) for i in range(150))
    assert 999 not in counts


def test_document_without_terms_has_zeros_and_no_label(spark, corpus):
    docs, weights, model = corpus
    w = rl.nmf_transform(weights.matrix, model.h, model.settings, docs=docs)
    assert w.count() == 151 and w.filter("doc_id = 999").first().w == [0.0, 0.0, 0.0]
    empty = w.filter("doc_id = 999")
    assert [r.pct for r in rl.topic_shares(empty).collect()] == [None] * 3
    assert rl.topic_labels(empty).count() == 0
    assert rl.document_topics(empty).first().topics == []
    kept = {r.doc_id: r.w for r in model.w.collect()}
    assert all(np.allclose(r.w, kept[r.doc_id], atol=1e-6) for r in w.collect() if r.doc_id != 999)


def test_shuffled_lookup_gives_the_same_fit(corpus):
    _, weights, _ = corpus
    settings = rl.NMFSettings(2, max_rounds=2, tol=-1.0)
    a = rl.nmf_fit(weights.matrix, weights.vocabulary, settings)
    b = rl.nmf_fit(weights.matrix, weights.vocabulary, settings, max_bytes=0)
    assert a.objectives == pytest.approx(b.objectives)
    a.unpersist()
    b.unpersist()


def test_weights_stay_in_place_during_a_round(corpus):
    _, weights, _ = corpus
    placed = nmf.place_by_document(weights.matrix, "doc_id")
    placed.weights.count()
    h = nmf.initial_h(placed.weights, weights.vocabulary, 2, 1)
    targets = nmf.document_targets(placed.weights, h, "doc_id", 2, h_bytes=1)
    plan = targets._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    placed.unpersist()


def test_solver_meets_the_optimality_conditions(spark):
    rng = np.random.default_rng(0)
    base = rng.random((6, 4))
    gram, l1, l2 = base.T @ base, 0.05, 0.05
    goals = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(g.tolist(),) for g in goals], "t array<double>")
    solve = nonnegative_solver(gram, l1, l2, 2000, 1e-12)
    for t, w in df.select("t", solve("t")).collect():
        t, w = np.array(t), np.array(w)
        slope = gram @ w - t + l1 + l2 * w
        assert (w >= 0).all() and (slope >= -1e-8).all() and abs(slope @ w) < 1e-8


def test_share_of_exactly_one_fifth_is_a_label(spark):
    w = spark.createDataFrame([(1, [1.0, 1.0, 1.0, 1.0, 1.0]), (2, [0.19, 0.81, 0.0])], "doc_id long, w array<double>")
    labels = {(r.doc_id, r.topic) for r in rl.topic_labels(w).collect()}
    assert labels == {(1, t) for t in range(5)} | {(2, 1)}
    shown = rl.document_topics(w, doc_id=2).first().topics
    assert [(round(p.pct, 2), p.topic) for p in shown] == [(0.81, 1)]
    assert [p.topic for p in rl.document_topics(w, doc_id=1).first().topics] == [0, 1, 2, 3, 4]


H = [("a", 0, [1.0, 0.0, 2.0]), ("b", 1, [0.0, 0.0, 2.0]), ("c", 2, [3.0, 0.0, 1.0]), ("d", 3, [1.0, 0.0, 0.0])]


@pytest.fixture(scope="module")
def h(spark):
    return spark.createDataFrame(H, "term string, term_idx long, h array<double>")


def cosine(a, b):
    norm = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / norm) if norm else 0.0


def test_similarity_of_topics(h):
    m = np.array([r[2] for r in H]).T
    pairs = {(r.topic_a, r.topic_b): r.cosine for r in rl.topic_similarity(h, 3).collect()}
    expected = {(i, j): cosine(m[i], m[j]) for i in range(3) for j in range(i + 1, 3)}
    assert pairs == pytest.approx(expected)
    assert rl.mean_similarity(h, 3).first().mean_cosine == pytest.approx(np.mean(list(expected.values())))


def test_similarity_over_columns_by_brute_force(h):
    m = np.array([r[2] for r in H]).T
    entries = [
        1.0 if m[i, a] > 0 and m[j, b] > 0 else 0.0
        for a in range(3)
        for b in range(a + 1, 3)
        for i in range(3)
        for j in range(3)
    ]
    assert rl.mean_similarity_of_columns(h, 3).first().mean_cosine == pytest.approx(np.mean(entries))


def test_one_topic_has_similarity_one(spark):
    one = spark.createDataFrame([("a", 0, [1.0])], "term string, term_idx long, h array<double>")
    assert rl.mean_similarity(one, 1).first().mean_cosine == 1.0
    assert rl.mean_similarity_of_columns(one, 1).first().mean_cosine == 1.0


def test_word_reports(h):
    freq = {(r.topic, r.term): r.frequency for r in rl.word_frequency(h).collect()}
    assert freq[(0, "c")] == pytest.approx(0.6) and freq[(1, "a")] is None
    best = [(r.topic, r.term) for r in rl.top_words(h, 2).orderBy("topic", "rank").collect()]
    assert best == [(0, "c"), (0, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert [r.term for r in rl.cloud_words(h, 1).filter("topic = 2").collect()] == ["a"]
    assert [r.term for r in rl.top_words(h, 1, topic=0).collect()] == ["c"]


def test_summary_lists_empty_topics(spark, h):
    w = spark.createDataFrame([(1, [1.0, 0.0, 1.0]), (2, [1.0, 0.0, 0.0])], "doc_id long, w array<double>")
    rows = {r.topic: (r.n_docs, r.words) for r in rl.topic_summary(h, w, 3, 2).collect()}
    assert rows == {0: (2, ["c", "a"]), 1: (0, ["a", "b"]), 2: (1, ["a", "b"])}
    assert [r.topic for r in rl.largest_topics(w, 3, 2).collect()] == [0, 2]


def test_shared_topics_match_terms_across_corpora(spark):
    pro = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0])], "term string, term_idx long, h array<double>")
    con = spark.createDataFrame([("b", 0, [2.0, 0.1]), ("z", 1, [0.0, 1.0])], "term string, term_idx long, h array<double>")
    models = [rl.NMFModel(rl.NMFSettings(2), df, df, "doc_id") for df in (pro, con)]
    rows = rl.shared_topics(*models, threshold=0.3).collect()
    assert [(r.pro_topic, r.con_topic, round(r.cosine, 6)) for r in rows] == [(1, 0, 1.0)]


def test_sweep_and_runs_by_polarity(corpus):
    docs, weights, _ = corpus
    rows = rl.topic_sweep(weights.matrix, weights.vocabulary, [1, 3], rl.NMFSettings(1, max_rounds=8)).collect()
    assert [r.topics for r in rows] == [1, 3] and rows[0].mean_cosine == 1.0
    assert rows[1].error < rows[0].error and rows[1].mean_cosine < 0.2
    reviews = docs.withColumn("pro_or_con", F.when(F.col("doc_id") % 2 == 0, "pro").otherwise("con"))
    runs = rl.topic_runs(reviews, {"pro": 3, "con": 2}, min_df=2, max_df=1.0)
    assert runs["pro"].summary.count() == 3 and runs["con"].summary.count() == 2
    for run in runs.values():
        run.unpersist()


def test_sweep_equals_single_fits(spark, corpus, monkeypatch):
    from reviewloom.operators import nmf_sweep

    _, weights, _ = corpus
    settings = rl.NMFSettings(1, tol=-1.0, max_rounds=2)
    singles = [rl.nmf_fit(weights.matrix, weights.vocabulary, replace(settings, topics=k)) for k in (1, 3)]
    terms = weights.vocabulary.count()
    small = {"BLOCK_WEIGHTS": 60, "CHUNK": 25, "PART_BYTES": 500, "FAN_IN": 2}
    # all in one broadcast, and in two with many small blocks
    for limits, max_bytes in (({}, 1 << 20), (small, terms * 3 * 8)):
        for name, value in limits.items():
            monkeypatch.setattr(nmf_sweep, name, value)
        fits = rl.fit_side_by_side(weights.matrix, weights.vocabulary, [1, 3], settings, max_bytes=max_bytes)
        for fit, single in zip(fits, singles):
            assert fit.objectives == pytest.approx(single.objectives) and fit.errors == pytest.approx(single.errors)
            cosine = rl.mean_similarity(single.h, fit.topics).first().mean_cosine
            assert fit.mean_cosine() == pytest.approx(cosine)
            coded = rl.mean_similarity_of_columns(single.h, fit.topics).first().mean_cosine
            assert fit.mean_cosine_of_columns() == pytest.approx(coded)
    model = rl.sweep_model(fits[1], weights.matrix, weights.vocabulary)
    wanted = {r.doc_id: r.w for r in singles[1].w.collect()}
    assert all(np.allclose(r.w, wanted[r.doc_id], atol=1e-6) for r in model.w.collect())
    terms_of = lambda k: terms * k * 8
    swept = rl.topic_sweep(weights.matrix, weights.vocabulary, [1, 3], settings, max_bytes=terms_of(1)).collect()
    assert [r.error for r in swept] == pytest.approx([fit.errors[-1] for fit in fits])
    with pytest.raises(ValueError, match="larger than"):
        rl.fit_side_by_side(weights.matrix, weights.vocabulary, [4], settings, max_bytes=100)
    with pytest.warns(UserWarning, match="not settled"):
        assert not rl.fit_side_by_side(weights.matrix, weights.vocabulary, [3], rl.NMFSettings(1, max_rounds=1))[0].converged
    assert rl.fit_side_by_side(weights.matrix, weights.vocabulary, [3], rl.NMFSettings(1, tol=1e-2))[0].converged
    none = weights.matrix.filter("false")
    assert [f.errors[-1] for f in rl.fit_side_by_side(none, weights.vocabulary.filter("false"), [2], settings)] == [0.0]


def test_certificate_tells_settled_from_cut_short(corpus):
    _, weights, _ = corpus
    settled, cut = (
        rl.sweep_model(rl.fit_side_by_side(weights.matrix, weights.vocabulary, [3], s)[0], weights.matrix, weights.vocabulary)
        for s in (rl.NMFSettings(1, tol=1e-9, max_rounds=500), rl.NMFSettings(1, tol=-1.0, max_rounds=1))
    )
    good = rl.optimality(weights.matrix, settled).collect()
    keys = {("term", r.term) for r in weights.vocabulary.collect()} | {("document", str(r.doc_id)) for r in settled.w.collect()}
    assert {(r.part, r.key) for r in good} == keys and max(r.breach for r in good) < 1e-2
    assert max(r.breach for r in rl.optimality(weights.matrix, cut).collect()) > 2e-2
    # a factor that is changed by hand is found
    spoilt = rl.NMFModel(settled.settings, settled.h.withColumn("h", F.transform("h", lambda v: v * 2)), settled.w, "doc_id")
    assert min(r.breach for r in rl.optimality(weights.matrix, spoilt).filter("part = 'document'").collect()) > 0.1


def test_solver_does_not_see_its_batch(spark):
    rng = np.random.default_rng(4)
    base = rng.random((6, 3))
    gram = base.T @ base + 0.01 * np.eye(3)
    rows = [(i, (gram @ (rng.random(3) * 10.0 ** rng.integers(-3, 3))).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, t array<double>")
    solve = nonnegative_solver(gram, 0.01, 0.001, None, 1e-6)
    found = []
    for batch, parts in ((1, 3), (100, 1), (10_000, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found.append(sorted((r.i, tuple(r.w)) for r in df.repartition(parts).select("i", solve("t").alias("w")).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == found[2]


def test_a_fit_that_is_cut_short_says_so(spark):
    rows = [(i, j, 1.0 + (i * j) % 5) for i in range(20) for j in range(6) if (i + j) % 3]
    matrix = spark.createDataFrame(rows, "doc_id long, term_idx long, tfidf double")
    vocabulary = spark.createDataFrame([(j, f"t{j}", 9) for j in range(6)], "term_idx long, term string, df long")
    with pytest.warns(UserWarning, match="not settled"):
        assert not rl.nmf_fit(matrix, vocabulary, rl.NMFSettings(2, max_rounds=2, tol=0.0)).converged
    assert rl.nmf_fit(matrix, vocabulary, rl.NMFSettings(2, tol=1e-3)).converged


def test_a_round_deals_terms_and_blocks_out(spark, corpus, monkeypatch):
    """Terms are solved by as many tasks as documents, and a chunk holds few weights where vectors are long."""
    from reviewloom.operators import nmf_sweep
    from reviewloom.operators.nmf import place_by_document

    _, weights, _ = corpus
    terms = weights.vocabulary.count()
    placed = place_by_document(weights.matrix, "doc_id")
    blocks = nmf_sweep.weight_blocks(placed.weights, "doc_id")
    for row in blocks.collect():
        order = np.frombuffer(row.by_term, dtype=np.int32)
        assert (np.diff(np.frombuffer(row.terms, dtype=np.int64)[order]) >= 0).all()
    h = np.random.default_rng(1).random((terms, 2))
    found = []
    for values in (nmf_sweep.CHUNK_VALUES, 6):
        monkeypatch.setattr(nmf_sweep, "CHUNK_VALUES", values)
        fit = nmf_sweep.SweepFit(rl.NMFSettings(2), h, h.T @ h)
        _, summed, held = nmf_sweep._round(blocks, 4, [fit])
        parts = sorted((r.part, np.frombuffer(r.sums)) for r in summed.collect())
        assert len(parts) == 4
        found.append(np.concatenate([sums for _, sums in parts]))
        for kept in held:
            kept.unpersist()
    assert np.allclose(*found)


def test_a_round_sends_no_more_sums_than_cores(spark, corpus):
    """Many partitions of weights give the same sums, from as many tasks as run at once."""
    from reviewloom.operators import nmf_sweep
    from reviewloom.operators.nmf import place_by_document

    _, weights, _ = corpus
    terms, cores = weights.vocabulary.count(), spark.sparkContext.defaultParallelism
    placed = place_by_document(weights.matrix, "doc_id")
    h = np.random.default_rng(2).random((terms, 3))
    found = []
    for parts in (3 * cores, 1):
        spread = placed.weights.repartition(parts, "doc_id").sortWithinPartitions("doc_id")
        blocks = nmf_sweep.weight_blocks(spread, "doc_id")
        fit = nmf_sweep.SweepFit(rl.NMFSettings(3), h, h.T @ h)
        _, summed, held = nmf_sweep._round(blocks, parts, [fit])
        plan = summed._jdf.queryExecution().executedPlan().toString()
        assert f"Coalesce {min(parts, cores)}" in plan
        moments, new, of_new = nmf_sweep._term_step(summed, [fit], [0])
        assert np.allclose(of_new[0][0], new.T @ new)
        last, none, _ = nmf_sweep._term_step(summed, [fit], [])
        assert none is None and np.array_equal(last[0][0], moments[0][0])
        found.append((moments[0][0], new))
        for kept in held:
            kept.unpersist()
    assert np.allclose(found[0][0], found[1][0]) and np.allclose(found[0][1], found[1][1], atol=1e-6)


def test_solver_equals_descent_written_out(monkeypatch):
    from reviewloom.functions import vectors

    rng = np.random.default_rng(5)
    base = rng.random((7, 4))
    gram, goal = base.T @ base, rng.normal(1.0, 2.0, (50, 4))
    wanted = np.zeros_like(goal)
    for row, target in zip(wanted, goal):
        for _ in range(3):
            for j in range(4):
                rest = target[j] - 0.05 - (row @ gram[j] - row[j] * gram[j, j])
                row[j] = max(0.0, rest / (gram[j, j] + 0.05))
    whole = vectors.solve_rows(goal, gram, 0.05, 0.05, 3, -1.0)
    assert np.allclose(whole, wanted)
    monkeypatch.setattr(vectors, "SOLVED_AT_ONCE", 8)
    assert (vectors.solve_rows(goal, gram, 0.05, 0.05, 3, -1.0) == whole).all()


def test_topic_run_fits_on_packed_blocks_as_nmf_fit_does(spark, monkeypatch):
    from reviewloom.operators import nmf_sweep
    from reviewloom.plans import flows

    words = ["pay", "good", "team", "boss", "food", "park"]
    texts = [(i, " ".join(words[(i * j + j) % 6] for j in range(1, 5 + i % 3))) for i in range(24)]
    docs = spark.createDataFrame(texts, "doc_id long, lemmatized_text string")
    settings = rl.NMFSettings(2, max_rounds=2, tol=-1.0)
    whole = nmf_sweep.nmf_fit

    def values(model):
        h = {row.term: [round(v, 8) for v in row.h] for row in model.h.collect()}
        return h, {row.doc_id: [round(v, 8) for v in row.w] for row in model.w.collect()}, model.converged

    calls = []

    def counted(*options):
        calls.append(1)
        return whole(*options)

    monkeypatch.setattr(nmf_sweep, "nmf_fit", counted)
    run = flows.topic_run(docs, settings, min_df=1, max_df=1.0)
    assert not calls
    other = nmf_sweep.fit_topics(run.tfidf.matrix, run.tfidf.vocabulary, settings, max_bytes=8)
    assert len(calls) == 1
    assert values(run.model) == values(other)
    assert run.model.objectives == pytest.approx(other.objectives) and run.model.errors == pytest.approx(other.errors)
    bare = flows.topic_run(docs.withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id"))), settings, min_df=1, max_df=1.0)
    assert len(calls) == 2 and None in values(bare.model)[1]
