"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logweir.llm.common import Batches, batch, discard, stored

LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
LINKS_PER_FLUSH = 1 << 20
FEW = 1 << 20


def roots(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``nodes`` indices over links between ``a`` and ``b``."""
    root = np.arange(nodes)
    while a.size:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link for each node but the smallest of its component: (node, smallest)."""
    ids, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = roots(len(ids), where[: len(a)], where[len(a) :])
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _contract(batches: Batches) -> Batches:
    """Stars of a task's own links, a bounded number of links at a time."""
    a, b, waiting = [], [], 0
    for x in batches:
        a.append(x["a"].to_numpy(zero_copy_only=False))
        b.append(x["b"].to_numpy(zero_copy_only=False))
        waiting += len(x)
        if waiting > LINKS_PER_FLUSH:
            yield batch(LINKS, *stars(np.concatenate(a), np.concatenate(b)))
            a, b, waiting = [], [], 0
    if waiting:
        yield batch(LINKS, *stars(np.concatenate(a), np.concatenate(b)))


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """``links``: long columns a, b. Returns ``node``, ``root`` (the component's smallest node) for every node that is linked.

    Tasks first replace their own links by stars. No more than ``few`` links that are left are finished by one task, which holds them
    all (16 bytes each). While there are more, every node's larger neighbours are linked to its smallest one, and its smaller
    neighbours likewise, until nothing changes; the rounds grow with the logarithm of the longest chain. Minima are
    aggregated before they are shuffled, so a node with very many links is no task's burden.
    """
    now = stored(links.select("a", "b").filter("a <> b").mapInArrow(_contract, "a long, b long").distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
        if state[0] <= few:
            last, now = now, stored(now.coalesce(1).mapInArrow(_contract, "a long, b long"), "links")
            discard(last)
            break
        # larger neighbours to the smallest of the neighbourhood
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # the node and its smaller neighbours to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(lowest.select("a", F.col("m").alias("b")))
        last, now = now, stored(small.distinct(), "links")
        discard(last)
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(tops)
