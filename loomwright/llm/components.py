"""Connected components of a graph of links, by alternating large and small stars.

Each round is two shuffles on node ids; the number of rounds grows with the logarithm of the
longest path.  A node with very many neighbours is no danger: both stars reduce to a minimum
per node and an explode, never a collected list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import cut_lineage


def _star(e: DataFrame, large: bool) -> DataFrame:
    """``e`` holds (u, v).  Links each neighbour to the least node of its neighbourhood."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    links = joined.where(F.col("v") > F.col("u")) if large else joined
    out = links.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the least node of its component for every node with a link.

    ``links`` may repeat links and hold both directions; null ends and loops are left out.
    """
    e = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct()
    e, before = cut_lineage(e), None
    while True:  # every round but the last moves links nearer to the least node
        e = cut_lineage(_star(_star(e, True), False))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
