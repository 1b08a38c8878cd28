"""Main text of web pages: boosted trees score the nodes of a page, decoding makes them agree."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import boosting
from reviewloom.llm.common import body, share, slices, table
from reviewloom.llm.html_layouts import Layout
from reviewloom.llm.html_tree import block_text, decode, features, parse

TRAINING_PAGES = 800


def labelled_nodes(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of marked pages."""
    x, y = [], []
    for page in pages:
        nodes, _ = parse(page)
        x.extend(features(nodes))
        label: list[int] = []
        for node in nodes:
            label.append(int(node.keep) if node.keep is not None else label[node.parent.index] if node.parent else 0)
        y.extend(label)
    return np.array(x, dtype=np.float64), np.array(y, dtype=np.float64)


def train(pages: int = TRAINING_PAGES) -> boosting.Trees:
    """Model of ``pages`` made-up pages; the bound is the parameter, the same pages each time."""
    return boosting.fit(*labelled_nodes([Layout(seed).page() for seed in range(pages)]))


def extract(model: boosting.Trees, pages: list[str]) -> list[str]:
    """Main text of each page."""
    parsed = [parse(page) for page in pages]
    lines = [features(nodes) for nodes, _ in parsed]
    scores = model.scores(np.array([row for page in lines for row in page], dtype=np.float64)).tolist()
    out, at = [], 0
    for nodes, pieces in parsed:
        out.append(block_text(pieces, decode(nodes, scores[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract_pages(
    pages: DataFrame, model: boosting.Trees | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text`` for each row.

    NULL, empty and markup-only pages have an empty text; markup that breaks off is read
    as far as it goes. Repeated rows repeat; an empty table gives no rows; other columns
    are not read. Pages are read in their scan's tasks, nothing is shuffled.
    """
    shared = share(pages.sparkSession, model or train())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = pickle.loads(shared.value)
        for batch in batches:
            for part in slices(batch, 2, rows=500):
                texts = extract(trees, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
                )

    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body(html_col).alias("html"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema][:2]
    return chosen.mapInArrow(work, ", ".join([*kinds, "text string"]))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
