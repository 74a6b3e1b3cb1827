"""Connected components of a graph given by its links, by alternating star contractions.

A large star ties every greater neighbour of a node to the least node of its neighbourhood, a small
star does so for the node and its lesser neighbours. Neither adds links. When both change nothing,
every node is tied to the least node of its component; that takes few rounds even for long chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import joined_by_key, staged


def _star(links: DataFrame, total: int, large: bool) -> DataFrame:
    """Links (a > b) of one contraction of the links (a > b)."""
    near = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    tied = joined_by_key(near, least, "u", "n", total)
    if large:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    """Count and checksum of the links."""
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link; the component is its least node.

    ``links`` has two columns ``a`` and ``b`` of one comparable type, in any direction; links of a node to
    itself and nulls are ignored, repeated ones count once. Without links the result has no rows.
    """
    now = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b and a is not null and b is not null").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        half = staged(_star(now, 2 * mark[0], large=True), "large-star")
        now = staged(_star(half, mark[0], large=False), "small-star")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
