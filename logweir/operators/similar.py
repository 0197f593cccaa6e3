"""Clusters of templates whose words are alike to a threshold.

A similarity join without comparing all pairs: tokens have one global order, the rarest first. Two sets whose Jaccard similarity reaches the threshold
share a token among the first few of both (the prefix), and neither is much larger than the other; pairs that meet by a prefix token
and pass the size test are compared exactly. Templates with one set of tokens are one class, and classes that are linked are one cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweir.operators.components import components
from logweir.operators.mining import mine_patterns
from logweir.session import materialise

ROOM = 1e-9  # for the rounding of a threshold times a size


def _prefix(size: Column, threshold: float) -> Column:
    return (size - F.ceil(size * threshold - ROOM) + 1).cast("int")


def token_sets(patterns: DataFrame, key: str = "id", text: str = "pattern") -> DataFrame:
    """Each distinct set of tokens once: ``class_id`` (its smallest key) and ``tokens``, the rarest first; equal counts in byte order."""
    split = patterns.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(F.split(text, " ", -1))).alias("tokens"))
    classes = split.groupBy("tokens").agg(F.min("key").alias("class_id"))
    each = classes.select("class_id", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(counts, "token").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))  # as many as a template has
    return ordered.select("class_id", F.col("t.token").alias("tokens"))


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes (a < b) whose similarity reaches the threshold, which is above 0: a, b, similarity."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    size = F.size("tokens")
    rows = sets.select("class_id", "tokens", size.alias("size"), F.explode(F.slice("tokens", F.lit(1), _prefix(size, threshold))).alias("token"))
    x, y = rows.alias("x"), rows.alias("y")
    fits = F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * threshold - ROOM
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.class_id") < F.col("y.class_id")) & fits)
    shared = F.size(F.array_intersect("x.tokens", "y.tokens"))
    likeness = shared / (F.col("x.size") + F.col("y.size") - shared)
    found = met.select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b"), likeness.alias("similarity"))
    return found.filter(F.col("similarity") >= threshold - ROOM).distinct()


def clusters_similar(patterns: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Clusters of mined templates (``mine_patterns``): id (the smallest template's), center (the most frequent template), templates, size (their rows),
    similarity (the least of the cluster's links, 1 without one). Clusters of one row are left out.
    """
    patterns = materialise(patterns.select("id", "pattern", "frequency"), "templates")
    sets = materialise(token_sets(patterns), "template-sets")
    links = materialise(similar_pairs(sets, threshold), "template-links")
    roots = components(links.select("a", "b"))
    least = links.join(roots, F.col("a") == F.col("node")).groupBy("root").agg(F.min("similarity").alias("similarity"))
    classes = sets.join(roots, F.col("class_id") == F.col("node"), "left").select(F.array_sort("tokens").alias("tokens"), F.coalesce("root", "class_id").alias("root"))
    named = patterns.withColumn("tokens", F.array_sort(F.array_distinct(F.split("pattern", " ", -1)))).join(classes, "tokens")
    # the smallest text of the most frequent ones
    most = named.groupBy("root").agg(F.max("frequency").alias("f"))
    center = named.join(most, "root").filter("frequency = f").groupBy("root").agg(F.min("pattern").alias("center"))
    out = named.groupBy("root").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("templates"), F.sum("frequency").alias("size")).filter("size >= 2")
    return out.join(center, "root").join(least, "root", "left").select("id", "center", "templates", "size", F.coalesce("similarity", F.lit(1.0)).alias("similarity"))


def mine_clusters(logs: DataFrame, threshold: float = 0.7, *, message: str = "message", order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """``clusters_similar`` of the templates of a logs table."""
    return clusters_similar(mine_patterns(logs, message=message, order=order), threshold)
