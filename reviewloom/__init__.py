"""Review topic analytics on Spark DataFrames."""

from reviewloom.operators.employers import (
    segment,
    select_middle,
    select_tails,
    split_by_mean,
    work_batches,
    work_list,
    work_order,
)
from reviewloom.operators.histogram import histogram, segmented_histogram
from reviewloom.operators.lemmas import default_stop_words, lemma_tokens, lemmatize
from reviewloom.operators.nmf import NMFModel, NMFSettings, nmf_fit, nmf_transform, optimality, reconstruction_error
from reviewloom.operators.nmf_sweep import SweepFit, fit_side_by_side, sweep_model
from reviewloom.operators.pages import extract_reviews, flag_blocked, page_facts, page_plan
from reviewloom.operators.ranking import exact_quantiles, global_rank, with_row_id
from reviewloom.operators.reviews import (
    add_recollected,
    combine_reviews,
    coverage_check,
    drop_junk,
    recollect_lists,
    split_polarity,
)
from reviewloom.operators.tfidf import tfidf
from reviewloom.operators.topics import (
    cloud_words,
    document_topics,
    largest_topics,
    mean_similarity,
    mean_similarity_of_columns,
    shared_topics,
    top_words,
    topic_labels,
    topic_shares,
    topic_similarity,
    topic_sizes,
    topic_summary,
    topic_sweep,
    word_frequency,
)
from reviewloom.plans import TopicRun, build_reviews, select_employers, topic_run, topic_runs
from reviewloom.sources import load_employers, missing_pages

__all__ = [
    "NMFModel",
    "NMFSettings",
    "TopicRun",
    "add_recollected",
    "build_reviews",
    "cloud_words",
    "combine_reviews",
    "coverage_check",
    "default_stop_words",
    "document_topics",
    "drop_junk",
    "exact_quantiles",
    "extract_reviews",
    "flag_blocked",
    "global_rank",
    "histogram",
    "largest_topics",
    "lemma_tokens",
    "lemmatize",
    "load_employers",
    "mean_similarity",
    "mean_similarity_of_columns",
    "missing_pages",
    "SweepFit",
    "fit_side_by_side",
    "sweep_model",
    "optimality",
    "nmf_fit",
    "nmf_transform",
    "page_facts",
    "page_plan",
    "recollect_lists",
    "reconstruction_error",
    "segment",
    "segmented_histogram",
    "select_employers",
    "select_middle",
    "select_tails",
    "shared_topics",
    "split_by_mean",
    "split_polarity",
    "tfidf",
    "top_words",
    "topic_labels",
    "topic_run",
    "topic_runs",
    "topic_shares",
    "topic_similarity",
    "topic_sizes",
    "topic_summary",
    "topic_sweep",
    "with_row_id",
    "word_frequency",
    "work_batches",
    "work_list",
    "work_order",
]
