"""Connected components of an edge table, as joins and pre-aggregated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.session import cut_lineage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) edges -> (node, component): each node with an edge and the smallest node it reaches.

    Alternates two steps until every component is a star around its minimum:
    every node hands its larger neighbours to the smallest node it knows, then
    its smaller ones. Minima are combined before the shuffle, so a node with
    very many edges is no bottleneck; each round is a table in the shared folder.
    """
    now = cut_lineage(_ordered(edges))
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        handed = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(_ordered(handed))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        handed = large.join(least, "a")
        now = cut_lineage(
            _ordered(
                handed.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                    least.select("a", F.col("m").alias("b"))
                )
            )
        )
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _ordered(edges: DataFrame) -> DataFrame:
    """Larger end first, no loops, no repeats."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
