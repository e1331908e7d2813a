"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitgraph.plans import Workspace


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of a link that is not its own root.

    `links` has bigint columns a, b. Each round is written, so its lineage ends there; rounds grow
    with the logarithm of the longest chain.
    """
    state = work.save(_ordered(links), "links")
    while True:
        low = state.df.select("a", "b").union(state.df.select("b", "a")).toDF("u", "v")
        least = low.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = low.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = work.save(_ordered(large), "large")
        least = large.df.groupBy("a").agg(F.min("b").alias("m"))
        small = large.df.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        done = work.save(
            _ordered(small), "small", digest=F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))
        )
        before = state.measures.get("digest")
        work.drop(state, large)
        if before == done.measures["digest"] and state.rows == done.rows:
            return done.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = done


def _ordered(links: DataFrame) -> DataFrame:
    return (
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    )
