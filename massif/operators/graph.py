"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.runtime import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the smallest node that it reaches.

    Alternates the large-star and small-star steps: each node's larger neighbours, then its smaller ones, are
    linked to the smallest node of its neighbourhood, until the table no longer changes. The number of rounds grows with the
    logarithm of the longest path; a node of very many links is met through min() aggregates, which combine before a shuffle, and a join
    whose skewed side Spark can split. Every round is a written table; nothing is gathered in one task or in the driver.
    """
    edges = scratch.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = lambda df: tuple(df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first())
    before = mark(edges)
    while before[0]:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        step = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = scratch.save(step)
        after = mark(new)
        scratch.drop(edges)
        edges = new
        if after == before:
            break
        before = after
    # at the fixed point every node but the smallest of its component is linked to that one alone
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
