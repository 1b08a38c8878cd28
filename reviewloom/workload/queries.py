"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import reviewloom as rl
from reviewloom.functions.markup import clean_markup, first_element_text
from reviewloom.functions.text import ngrams, safe_name, stem, terms, tokens, url_slug
from reviewloom.operators.employers import cutoffs, min_count
from reviewloom.operators.lemmas import DOMAIN_STOP_WORDS
from reviewloom.operators.nmf import initial_h
from reviewloom.operators.pages import page_url
from reviewloom.operators.rows import explode_rows
from reviewloom.operators.tfidf import prune, term_counts, term_stats, with_index
from reviewloom.session import run_together
from reviewloom.sources import explode_employers, parse_pages, project_employers
from reviewloom.workload import fixtures as fx

MIN_DF = 20
PAGE_SIZE = 10
BLOCKED = "Nd, are. Thesblesh edon th to enntin enat oren reouedes ernd"
URL = "https://reviews.example.com/Reviews/%s-Reviews-E%s%s.htm"

# The factorisation small enough to be written out in SQL: fixed rounds and sweeps
CHECKED = rl.NMFSettings(topics=3, max_rounds=2, tol=-1.0, sweeps=4, sweep_tol=-1.0)

OPTIMAL = 0.01  # largest breach of the optimality conditions, as a part of the largest target

_held: list = []


def _hold(*owners):
    """Release what the previous query kept in memory and remember what this one keeps."""
    while _held:
        _held.pop().unpersist()
    _held.extend(owners)


def _r(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


# --- employers -------------------------------------------------------------


def employers_from_json(spark, d):
    return project_employers(explode_employers(parse_pages(fx.result_pages(spark, d))))


def json_values(spark, d):
    props = F.from_json("props", "k string")["k"].try_cast("int")
    return fx.table(spark, d, "events").select("event_id", props.alias("k"))


def missing_pages(spark, d):
    landed = fx.landed_pages(spark, d)
    return rl.missing_pages(landed, landed.agg(F.max("page_num")).first()[0] + 5)


def _employers(spark, d):
    """The employer table, kept: cut-offs, masks and counts each read it again."""
    kept = fx.employers(spark, d).persist()
    _hold(kept)
    return kept


def _tails(spark, d):
    employers = fx.employers(spark, d).persist()
    tails = rl.select_tails(employers, fx.MIN_RATINGS).persist()
    _hold(employers, tails)
    return tails


def employer_cutoffs(spark, d):
    return cutoffs(min_count(_employers(spark, d), fx.MIN_RATINGS))


def employers_tails(spark, d):
    return rl.select_tails(_employers(spark, d), fx.MIN_RATINGS)


def employers_middle(spark, d):
    return rl.select_middle(_employers(spark, d), fx.MIN_RATINGS)


def employers_good_bad(spark, d):
    good, bad = rl.split_by_mean(_tails(spark, d))
    return rl.work_list(good).select("*", F.lit("good").alias("side")).unionByName(
        rl.work_list(bad).select("*", F.lit("bad").alias("side"))
    )


def work_batches(spark, d):
    return rl.work_batches(_tails(spark, d))


def _rounded_bins(bins):
    return bins.select(*[c for c in bins.columns if c not in ("bin_low", "bin_high")], _r("bin_low"), _r("bin_high"))


def rating_histogram(spark, d):
    selected = min_count(_employers(spark, d), fx.MIN_RATINGS)
    return _rounded_bins(rl.histogram(selected, "overall_rating"))


def segmented_histogram(spark, d):
    parts = rl.segment(_employers(spark, d), fx.MIN_RATINGS)
    return _rounded_bins(rl.segmented_histogram({"middle": parts.employers, "tails": parts.tails}, "overall_rating"))


def chart_names(spark, d):
    name = safe_name(["Top ", F.col("p_name"), " ", F.col("p_brand"), ".png"])
    return fx.table(spark, d, "part").select("p_partkey", name.alias("name"))


# --- pages -----------------------------------------------------------------


def page_plan(spark, d):
    plan = fx.employers(spark, d).withColumn("page_size", F.lit(PAGE_SIZE))
    return rl.page_plan(plan, URL)


def page_facts(spark, d):
    return rl.page_facts(fx.list_pages(spark, d)).select("company_id", "num_ratings", "page_size")


def page_slugs(spark, d):
    title = first_element_text(clean_markup(F.col("html")), "h1")
    return fx.review_pages(spark, d).select(
        "company_id", url_slug(title).alias("slug"), page_url(title, F.col("company_id"), F.lit(2), URL).alias("url")
    )


def blocked_pages(spark, d):
    flagged = rl.flag_blocked(fx.review_pages(spark, d), BLOCKED)
    return flagged.select("company_id", first_element_text(clean_markup(F.col("html")), "h1").alias("title"), "blocked")


def reviews_from_html(spark, d):
    return rl.extract_reviews(fx.review_pages(spark, d), tag="article", css_class=None)


# --- reviews ---------------------------------------------------------------


def reviews_clean(spark, d):
    reviews = fx.reviews(spark, d, spread=False).drop("doc_id")
    return rl.drop_junk(rl.combine_reviews(reviews, reviews), fx.JUNK)


def reviews_numbered(spark, d):
    clean = rl.drop_junk(fx.reviews(spark, d, spread=False), fx.JUNK, id_col="doc_id")
    ranked = rl.global_rank(clean.select("doc_id", "company_name"), [F.col("doc_id")], "row_id")
    return ranked.select("row_id", "doc_id", "company_name")


def reviews_row_ids(spark, d):
    """Rows and different ids by side, with rows that differ only in which column is NULL."""
    clean = rl.drop_junk(fx.reviews(spark, d, spread=False), fx.JUNK, id_col="doc_id")
    rows = clean.select("company_name", "pro_or_con", "review_text")
    shifted = rows.filter(F.col("pro_or_con").isNull()).select(
        F.lit(None).cast("string").alias("company_name"), F.col("company_name").alias("pro_or_con"), "review_text"
    )
    numbered = rl.with_row_id(rows.unionByName(shifted), "row_id")
    counted = numbered.groupBy("company_name", "pro_or_con")
    return counted.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_ids"))


def _coverage(spark, d):
    return rl.coverage_check(fx.targets(spark, d), fx.reviews(spark, d, spread=False))


def coverage_check(spark, d):
    return _coverage(spark, d).withColumn("delta_pct", F.round("delta_pct", 6))


def coverage_by_id(spark, d):
    reviews = fx.reviews(spark, d, spread=False).withColumn("company_id", F.substring("company_name", 4, 10).cast("long"))
    check = rl.coverage_check(fx.targets(spark, d), reviews, key="company_id")
    return check.withColumn("delta_pct", F.round("delta_pct", 6))


def recollect_lists(spark, d):
    pros, cons = rl.recollect_lists(_coverage(spark, d))
    return pros.select("*", F.lit("pro").alias("side")).unionByName(cons.select("*", F.lit("con").alias("side")))


def reviews_recollected(spark, d):
    reviews = fx.reviews(spark, d, spread=False)
    first = reviews.filter(F.col("company_name") != "src1")
    again = reviews.filter(F.col("company_name").isin("src1", "src2"))
    return rl.add_recollected(first, again, fx.JUNK, id_col="doc_id").select("doc_id", "company_name", "pro_or_con")


def polarity_split(spark, d):
    pro, con = rl.split_polarity(fx.reviews(spark, d, spread=False))
    return pro.select("doc_id", F.lit("pro").alias("side")).unionByName(con.select("doc_id", F.lit("con").alias("side")))


# --- text ------------------------------------------------------------------


def text_tokens(spark, d):
    found = explode_rows(fx.reviews(spark, d), tokens(F.col("review_text")), "token")
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def lemma_tokens(spark, d):
    return rl.lemma_tokens(fx.reviews(spark, d), fx.lexicon(spark, d), DOMAIN_STOP_WORDS)


def lexicon_texts(spark, d):
    reviews = fx.reviews(spark, d).select("doc_id", "review_text")
    return rl.lemmatize(reviews, fx.lexicon(spark, d), DOMAIN_STOP_WORDS).select("doc_id", "lemmatized_text")


def lemmatized_text(spark, d):
    reviews = fx.reviews(spark, d)
    return rl.lemmatize(reviews, stop_words=DOMAIN_STOP_WORDS).select("doc_id", "pro_or_con", "lemmatized_text")


def stem_counts(spark, d):
    found = explode_rows(fx.reviews(spark, d), terms(F.col("review_text")), "term")
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(stem(F.col("term")).alias("stem")).agg(F.sum("n").alias("n"))


def ngram_counts(spark, d):
    words = fx.reviews(spark, d).select(terms(F.col("review_text")).alias("words"))
    found = explode_rows(words, ngrams(F.col("words"), 2), "ngram")
    return found.groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))


# --- weights ---------------------------------------------------------------


def _corpus(spark, d, polarity=None):
    reviews = fx.reviews(spark, d)
    return reviews if polarity is None else reviews.filter(F.col("pro_or_con") == polarity)


def term_statistics(spark, d):
    return term_stats(term_counts(_corpus(spark, d), text_col="review_text"))


def vocabulary(spark, d):
    docs = _corpus(spark, d)
    stats = term_stats(term_counts(docs, text_col="review_text"))
    kept = prune(stats, docs.count(), MIN_DF, 0.9).persist()
    _hold(kept)
    return with_index(kept)


def _weights(spark, d, polarity=None, **options):
    options = {"text_col": "review_text", "min_df": MIN_DF, **options}
    result = rl.tfidf(_corpus(spark, d, polarity), **options)
    _hold(result)
    return result


def _weight_rows(weights):
    return weights.matrix.select("doc_id", "term", "term_idx", "tf", _r("tfidf"))


def tfidf_smooth(spark, d):
    return _weight_rows(_weights(spark, d))


def tfidf_plain(spark, d):
    return _weight_rows(_weights(spark, d, idf_kind="plain", normalize=False))


def tfidf_max_features(spark, d):
    return _weight_rows(_weights(spark, d, max_features=50, max_df=0.5))


def tfidf_bigrams(spark, d):
    return _weight_rows(_weights(spark, d, ngram=2, min_df=5))


def top_terms_by_polarity(spark, d):
    weights = rl.tfidf(_corpus(spark, d), text_col="review_text", min_df=MIN_DF, normalize=True)
    _hold(weights)
    sides = fx.reviews(spark, d, spread=False).select("doc_id", "pro_or_con").filter(F.col("pro_or_con").isNotNull())
    sums = (
        weights.matrix.join(sides, "doc_id")
        .groupBy("pro_or_con", "term")
        .agg(F.round(F.sum("tfidf"), 6).alias("weight"))
    )
    order = W.partitionBy("pro_or_con").orderBy(F.desc("weight"), F.asc("term"))
    return sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 20)


# --- topics ----------------------------------------------------------------


def _fit(spark, d, polarity="pro", settings=CHECKED):
    weights = rl.tfidf(_corpus(spark, d, polarity), text_col="review_text", min_df=MIN_DF)
    model = rl.nmf_fit(weights.matrix, weights.vocabulary, settings)
    return weights, model


def _held_fit(spark, d):
    weights, model = _fit(spark, d)
    _hold(weights, model)
    return weights, model


def _columns(vector, k=CHECKED.topics):
    return [F.round(F.col(vector)[t], 6).alias(f"{vector}{t}") for t in range(k)]


def nmf_start(spark, d):
    weights = _weights(spark, d, "pro")
    x = weights.matrix.select("doc_id", "term_idx", F.col("tfidf").alias("x"))
    start = initial_h(x, weights.vocabulary, CHECKED.topics, CHECKED.seed, CHECKED.seed_documents)
    return start.select("term_idx", *_columns("h"))


def nmf_documents(spark, d):
    return _held_fit(spark, d)[1].w.select("doc_id", *_columns("w"))


def nmf_terms(spark, d):
    return _held_fit(spark, d)[1].h.select("term", *_columns("h"))


def nmf_transform(spark, d):
    weights, model = _held_fit(spark, d)
    docs = _corpus(spark, d, "pro").select("doc_id")
    return rl.nmf_transform(weights.matrix, model.h, CHECKED, docs=docs).select("doc_id", *_columns("w"))


def nmf_error(spark, d):
    weights, model = _held_fit(spark, d)
    error = rl.reconstruction_error(weights.matrix, model.w, model.h, CHECKED.topics)
    rows = [(i + 1, round(e, 5)) for i, e in enumerate([*model.errors, error])]
    return spark.createDataFrame(rows, "step int, error double")


def topic_shares(spark, d):
    return rl.topic_shares(_held_fit(spark, d)[1].w).select("doc_id", "topic", _r("pct"))


def topic_labels(spark, d):
    return rl.topic_labels(_held_fit(spark, d)[1].w).select("doc_id", "topic", _r("pct"))


def document_topics(spark, d):
    found = rl.document_topics(_held_fit(spark, d)[1].w)
    return found.select(
        "doc_id", F.array_join(F.transform("topics", lambda p: p["topic"].cast("string")), ",").alias("topics")
    )


def topic_words(spark, d):
    return rl.top_words(_held_fit(spark, d)[1].h).select("topic", "rank", "term", _r("weight"))


def topic_words_of_one(spark, d):
    return rl.top_words(_held_fit(spark, d)[1].h, 10, topic=1).select("topic", "rank", "term", _r("weight"))


def word_frequency(spark, d):
    return rl.word_frequency(_held_fit(spark, d)[1].h).select("topic", "term", _r("frequency"))


def cloud_words(spark, d):
    return rl.cloud_words(_held_fit(spark, d)[1].h).select("topic", "rank", "term", _r("frequency"))


def topic_sizes(spark, d):
    return rl.topic_sizes(_held_fit(spark, d)[1].w, CHECKED.topics)


def largest_topics(spark, d):
    return rl.largest_topics(_held_fit(spark, d)[1].w, CHECKED.topics, 2)


def topic_summary(spark, d):
    model = _held_fit(spark, d)[1]
    summary = rl.topic_summary(model.h, model.w, CHECKED.topics)
    return summary.select("topic", "n_docs", F.array_join("words", " ").alias("words"))


def topic_similarity(spark, d):
    pairs = rl.topic_similarity(_held_fit(spark, d)[1].h, CHECKED.topics)
    return pairs.select("topic_a", "topic_b", _r("cosine"))


def mean_similarity(spark, d):
    return rl.mean_similarity(_held_fit(spark, d)[1].h, CHECKED.topics).select("topics", _r("mean_cosine"))


def mean_similarity_of_columns(spark, d):
    found = rl.mean_similarity_of_columns(_held_fit(spark, d)[1].h, CHECKED.topics)
    return found.select("topics", _r("mean_cosine"))


def shared_topics(spark, d):
    (pro_weights, pro), (con_weights, con) = run_together(
        spark, [partial(_fit, spark, d, side) for side in ("pro", "con")], 2
    )
    _hold(pro_weights, pro, con_weights, con)
    return rl.shared_topics(pro, con, threshold=0.3).select("pro_topic", "con_topic", _r("cosine"))


def topic_sweep(spark, d):
    weights = _weights(spark, d, "pro")
    settings = rl.NMFSettings(topics=1)
    return rl.topic_sweep(weights.matrix, weights.vocabulary, range(1, 31), settings)


def nmf_certificate(spark, d):
    """Documents and terms of three fits that have settled, and whether each is optimal."""
    weights = _weights(spark, d, "pro")
    settings = rl.NMFSettings(topics=1, tol=1e-6, max_rounds=1000)
    fits = rl.fit_side_by_side(weights.matrix, weights.vocabulary, [2, 3, 5], settings)
    models = [rl.sweep_model(fit, weights.matrix, weights.vocabulary) for fit in fits]
    _hold(weights, *models)
    found = [rl.optimality(weights.matrix, m).withColumn("topics", F.lit(m.topics)) for m in models]
    optimal = (F.col("breach") <= OPTIMAL).cast("int").alias("optimal")
    return reduce(DataFrame.unionByName, found).select("topics", "part", "key", optimal)


def polarity_topics(spark, d):
    """Both corpora from review text to topic table, 21 and 15 topics, fitted until they settle."""
    lemmas = rl.lemmatize(_corpus(spark, d), stop_words=DOMAIN_STOP_WORDS)
    runs = rl.topic_runs(lemmas, {"pro": 21, "con": 15}, rl.NMFSettings(1), min_df=10)
    _hold(*runs.values())
    tables = [run.summary.select(F.lit(side).alias("side"), "*") for side, run in runs.items()]
    both = tables[0].unionByName(tables[1])
    return both.select("side", "topic", "n_docs", F.array_join("words", " ").alias("words"))


_QUERIES = (
    employers_from_json,
    json_values,
    missing_pages,
    employer_cutoffs,
    employers_tails,
    employers_middle,
    employers_good_bad,
    work_batches,
    rating_histogram,
    segmented_histogram,
    chart_names,
    page_plan,
    page_facts,
    page_slugs,
    blocked_pages,
    reviews_from_html,
    reviews_clean,
    reviews_numbered,
    reviews_row_ids,
    coverage_check,
    coverage_by_id,
    recollect_lists,
    reviews_recollected,
    polarity_split,
    text_tokens,
    lemma_tokens,
    lexicon_texts,
    lemmatized_text,
    stem_counts,
    ngram_counts,
    term_statistics,
    vocabulary,
    tfidf_smooth,
    tfidf_plain,
    tfidf_max_features,
    tfidf_bigrams,
    top_terms_by_polarity,
    nmf_start,
    nmf_documents,
    nmf_terms,
    nmf_transform,
    nmf_error,
    topic_shares,
    topic_labels,
    document_topics,
    topic_words,
    topic_words_of_one,
    word_frequency,
    cloud_words,
    topic_sizes,
    largest_topics,
    topic_summary,
    topic_similarity,
    mean_similarity,
    mean_similarity_of_columns,
    shared_topics,
    topic_sweep,
    nmf_certificate,
    polarity_topics,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}
