"""Connected components of a link table by alternating large and small stars, each round a few joins and a table."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import files_for, materialize

#: Links of one file of a round's tables (some 16 MB of digests).
LINKS_A_FILE = 500_000


def small_star(edges: DataFrame) -> DataFrame:
    """edges: distinct (u, v), u > v. Each u, and all its v but the least, link to its least v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return small.where("u <> v").distinct()


def connected(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """links: (a, b), any orderable type. Returns (node, root): every node of a link with its component's least node.

    It ends when all components are stars; where ``rounds`` are given and run out before, with an error.
    Links are only rewritten, never collected; nodes of many links are joined, not grouped."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    # Nodes with many smaller neighbours (sets that share several pivots) keep one link before links are read both ways.
    edges = materialize(edges)
    files = files_for(edges, LINKS_A_FILE)
    edges = materialize(small_star(edges).coalesce(files))
    for done in count():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A table, so that the join with nodes of many links is dealt anew where it is skewed.
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("links")).coalesce(files))
        # Where every node but the least of its neighbours has one link, all components are stars.
        if least.where((F.col("u") != F.col("m")) & (F.col("links") > 1)).isEmpty():
            break
        if done == rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        large = both.join(least.select("u", "m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        edges = materialize(small_star(large).coalesce(files))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
