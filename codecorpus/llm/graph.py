"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or itself)."""
    n = _both(edges)
    least = n.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return n.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    n = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = n.groupBy("u").agg(F.min("v").alias("m"))
    return (n.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v): each node with links and the smallest node of its component.

    ``edges`` has comparable columns u and v; nodes without links are left
    out, and a component's smallest node appears only as v. Each round is one
    written table; rounds grow with the logarithm of the largest component.
    """
    cur = stored(edges.select("u", "v").where("u <> v").distinct(), name)
    mark = None
    while True:
        cur = stored(_small_star(_large_star(cur)), name)
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark or not now[0]:
            return cur
        mark = now
