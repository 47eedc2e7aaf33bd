"""Connected components of a large link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelake.llm.common import written


def components(links: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links(a, b)``; component is the smallest reachable node.

    Alternates two star contractions until the links are stars around the smallest nodes: first
    each node's larger neighbours, then its smaller ones, are tied to its smallest neighbour. The number
    of rounds grows with the logarithm of the longest path. Each round is a written table. An
    empty link table gives an empty result.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = _print(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = written(tied, name)
        now = _print(edges)
        if now == seen:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
        seen = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _print(edges: DataFrame):
    """Count and order-free sums of the links: equal when a round has changed nothing."""
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
