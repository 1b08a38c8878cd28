"""Connected components of a link table, without a driver or a task holding them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import keep


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for the ids in ``links`` (``a, b``): the smallest id reachable.

    An id that is itself the smallest of its component has no row.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each id hands
    its smallest neighbour to the others, until every link goes to the smallest id of
    its component. Steps are joins and minima, so an id with very many links is a
    key that map-side minima and adaptive join splitting take care of. Each round is
    checkpointed.
    """
    low = F.least("a", "b")
    high = F.greatest("a", "b")
    edges = keep(links.select(high.alias("a"), low.alias("b")).filter("a != b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.filter("a != b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = (
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .filter("a != b")
            .distinct()
        )
        new = keep(small)
        # settled: every id has one link, and it goes to an id that has none upwards
        heads = new.select(F.col("b").alias("a")).distinct()
        several = new.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        settled = new.join(heads, "a", "left_semi").isEmpty() and several.isEmpty()
        edges = new
        if settled:
            break
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
