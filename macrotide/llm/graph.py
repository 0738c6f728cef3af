"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from macrotide.llm.store import discard, written


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): the least node of its component for every node of (a, b) but the roots themselves.

    Each round hangs neighbours to the least node they know, first larger ones, then smaller
    ones, until nothing moves (an error if that takes more than ``most_rounds``); a node with many links costs one row for each of them.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).dropDuplicates(), "links")
    mark = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).dropDuplicates()
        small = large.join(_least(large), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(_least(large).select("u", F.col("m").alias("v"))).dropDuplicates()
        before, edges = edges, written(small, "links")
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components still moved after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
