"""Mixing sources to target weights by weighted fair queueing.

The documents of a source stand in a shuffled queue, as often as the source may repeat. A document's virtual finish time is
what its source has sent up to its end, divided by the source's target. All queues are merged by finish time and the mix
ends at the budget, so at any point of the mix every source has had its share, but for one document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from logweir.llm.common import discard, pieces, stored, word_count

ROWS_PER_BUCKET = 50_000
WEIGHTS = (1.0, 2.0, 3.0)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.0, repeats: int = 3) -> DataFrame:
    """Each source's target: ``budget`` of all sizes shared by weight, none above ``repeats`` times its source's size.

    ``sizes``: one row per source (``source``, ``source_size``). Sources in order of code points, null last, weigh
    ``weights`` in turn. What a full source can't take is shared again by weight: the limit of that is one rate for all sources
    that are not full, and a source is full if its limit per weight is below the rate that is left after
    the sources that fill up earlier. Adds ``weight`` and ``target``.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    limit = F.col("source_size").cast("double") * repeats
    earlier = Window.orderBy(limit / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum(limit).over(earlier), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    rows = rows.withColumn("rate", left / weight_left).withColumn("full", limit < F.col("rate") * F.col("weight"))
    # the first source that does not fill up sets the rate
    rate = F.min_by(F.when(~F.col("full"), F.col("rate")), F.when(~F.col("full"), F.struct(limit / F.col("weight"), F.col("source")))).over(everything)
    return rows.withColumn("target", F.when(F.col("full"), limit).otherwise(F.least(rate * F.col("weight"), limit))).drop("rate", "full")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, budget: float = 1.0, repeats: int = 3, seed: int = 0, rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """The mix, and the queues it was drawn from.

    The mix has a row for each document it takes, each time it takes it: ``key``, ``text_hash``, ``place`` (the row's own, as equal rows are
    documents of their own), ``source``, ``size``, ``pass``, ``finish``, ``position`` (words of the mix before it). Order it by
    ``position``, ``finish``. The queues have every document: the same columns, ``source_size`` and ``target``.

    Size: words of the text (null or empty: 0). Documents without words cost nothing and are taken once if their turn
    comes. A null source is a source, the last. Sources without words have target 0 and give nothing. Reruns agree: the
    shuffle is a hash of the row. Other columns are not read; an empty table gives empty tables.

    No task holds a source or the mix: queues and the merged order are dealt into buckets (of the hash, of the
    finish time), summed, and each bucket starts at the sum of those before it.
    """
    rows = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(source).alias("source"), word_count(text).alias("size"))
    rows = sized = stored(rows.withColumn("turn", F.xxhash64("key", "text_hash", F.lit(seed))), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    shares = targets(sizes, weights, budget, repeats)
    buckets = pieces(rows.count(), rows_per_bucket)
    low = F.shiftrightunsigned("turn", 64 - buckets.bit_length() + 1) if buckets > 1 else F.lit(0).cast("long")
    rows = rows.withColumn("bucket", low)

    # the shuffled queue of each source
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    queue = Window.partitionBy("source", "bucket").orderBy("turn", "key", "text_hash")
    queued = rows.withColumn("place", F.row_number().over(queue)).withColumn("within", F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, 0)))
    queued = queued.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("sent", F.col("start") + F.col("within")).drop("s", "b", "start", "within")
    shares = shares.select(F.col("source").alias("s"), "source_size", "target")
    queued = stored(queued.join(F.broadcast(shares) if sizes.count() <= 10_000 else shares, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-queues")

    # all queues as one, by finish time; a stretch of finish time is a bucket
    copies = queued.filter("target > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("sent")) / F.col("target"))
    copies = copies.filter((F.col("size") > 0) | (F.col("pass") == 0))
    # even stretches at first, longer and longer ones where the mix has long ended
    late = F.lit(4.0) + F.log2(F.greatest(F.col("finish"), F.lit(4.0)) / 4)
    copies = copies.withColumn("stretch", F.floor(F.least(F.col("finish"), late) * (64 * buckets)).cast("long"))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    sums = copies.groupBy("stretch").agg(F.sum("size").alias("n")).select("stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    words = float(rows.agg(F.sum("size")).first()[0] or 0) * budget
    discard(sized)
    sums = sums.filter(F.col("start") < words)
    merged = Window.partitionBy("stretch").orderBy("finish", "source", "turn", "key", "text_hash", "place", "pass").rowsBetween(Window.unboundedPreceding, 0)
    placed = copies.join(sums, "stretch").withColumn("end", F.col("start") + F.sum("size").over(merged))
    mixed = placed.filter(F.col("end") <= words).withColumn("position", F.col("end") - F.col("size"))
    names = ["key", "text_hash", "bucket", "place", "source", "size"]
    return mixed.select(*names, "pass", "finish", "position"), queued.select(*names, "source_size", "target")


def taken(df: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Every document's size, its source's size and target, and the words of it that the mix takes, repeats counted."""
    mixed, queued = mix(df, key, **options)
    place = ["source", "bucket", "place"]
    counts = mixed.groupBy(*place).agg(F.sum("size").cast("long").alias("taken")).select(*[F.col(c).alias(f"m_{c}") for c in place], "taken")
    same = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in place]
    return queued.join(counts, same[0] & same[1] & same[2], "left").select(F.col("key").alias(key), "size", "source", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def draw(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, **options) -> DataFrame:
    """The rows of ``df`` that the mix takes, with all their columns, each as often as it is taken.

    A row is found again by key, text and source. Equal rows are taken alike: each as often as any of them.
    """
    mixed, _ = mix(df, key, text, source, seed=seed, **options)
    times = mixed.groupBy("key", "text_hash", "source", "place", "bucket").count().groupBy("key", "text_hash", "source").agg(F.max("count").alias("n"))
    times = times.select(F.struct("key", "text_hash", "source").alias("__mix_row"), F.col("n").cast("int").alias("__mix_n"))
    rows = df.withColumn("__row", F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(source).alias("source")))
    found = rows.join(times, F.col("__row").eqNullSafe(F.col("__mix_row")))
    return found.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__mix_n")))).select(*df.columns)
