"""Connected components by alternating star contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link at most and none leads to a node that has one."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("met")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("met")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("met").alias("met")).where("out > 1 or (out = 1 and met = 1)").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour or itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(least.withColumnRenamed("low", "v")).where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link; a component is named by its smallest node.

    The number of passes grows with the logarithm of the longest chain, and they end when every
    link leads from a node to its component's smallest; each pass is written to the shared checkpoint folder, so a lost executor costs one pass.
    The least neighbours of the large star are written too: both sides of its join are
    then shuffled for the join alone, and a node with very many links can be split.
    """
    now = keep(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    while True:
        now = keep(_small_star(_large_star(now)))
        if _stars(now):
            break
    member = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.unionByName(member.select(F.col("component").alias("node"), "component")).distinct()
