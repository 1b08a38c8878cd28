"""Queries of the operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewloom.llm import (
    bpe_lexicon, chat_format, embedding_join, exact_dedup, html_extract, minhash_dedup, mixture_packing, packing, periodic_runs,
    phrase_mining, quality, sharding, toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        sharding.op1_jump_sharding,
        html_extract.op2_html_extraction,
        packing.op3_best_fit_packing,
        chat_format.op4_chat_windows,
        exact_dedup.op5_exact_dedup,
        bpe_lexicon.op6_bpe_lexicon,
        quality.op7_quality_bayes,
        toxicity.op8_toxicity_neighbours,
        embedding_join.op9_grid_order_join,
        minhash_dedup.op10_minhash_near_dedup,
        mixture_packing.op11_mixture_packing,
        periodic_runs.op12_periodic_runs,
        phrase_mining.op13_phrase_mining,
    )
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jump_sharding": sharding.ORACLE,
        "op4_chat_windows": chat_format.ORACLE,
        "op5_exact_dedup": exact_dedup.ORACLE,
        "op9_grid_order_join": embedding_join.ORACLE,
        "op10_minhash_near_dedup": minhash_dedup.ORACLE,
        "op13_phrase_mining": phrase_mining.ORACLE,
    }
