"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import stage


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): every linked node with the smallest node that it reaches.

    Each round points the larger neighbours of every node to its smallest one, then every node and its smaller
    neighbours likewise (Kiveris et al. 2014). Links never grow in number, and each round is written out, so a lost
    executor repeats one round at most. No links: no rows.
    """
    pairs = edges.where(F.col("a") != F.col("b"))
    tree = stage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while (now := _digest(tree)) != before:
        before = now
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where(F.col("u") != F.col("v")).distinct(), "large-star")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where(F.col("u") != F.col("v")).unionByName(down.select("u", F.col("m").alias("v")))
        tree = stage(small.distinct(), "small-star")
    roots = tree.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(tree.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
