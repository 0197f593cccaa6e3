"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logweir.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b of one orderable type. Returns ``node`` and ``root``, the component's smallest node, for every node that is linked to another.

    In each round every node's larger neighbours are linked to the smallest of its neighbourhood, then a node and its smaller neighbours to the smallest
    of those, until nothing changes; the rounds grow with the logarithm of the longest chain. Minima are aggregated before
    the shuffle, so a node with very many links is no task's burden. Links are a table of the shared folder between rounds.
    """
    now, seen = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "component-links"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(lowest.select("a", F.col("m").alias("b")))
        now = materialise(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-links")
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(tops)
