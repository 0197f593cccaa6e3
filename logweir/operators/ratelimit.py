"""Token-bucket rate limit in event time.

A bucket starts full, gains ``fill`` tokens per tick up to ``capacity``, and each
row takes one token or is dropped. Only ticks that hold rows are looked at.

What a run of ticks does to the level on entry is always ``min(top, max(floor,
level + shift))``, and such steps compose. So runs of at most ``BLOCK`` ticks are
folded on their own, then runs of blocks, then runs of those: a tree of effects. What is left of a
key at the top, one entry for each ``BLOCK ** (LEVELS + 1)`` ticks of time, is chained, and the levels on entry go down the tree again to the
blocks and their ticks. No task handles more than ``BLOCK`` entries of a key at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweir.functions.ranks import first_rows

BLOCK = 1024
LEVELS = 2  # of runs above the blocks


def _ticks(df: DataFrame, key: str, time: str, tick_ms: int) -> DataFrame:
    tick = F.floor(F.unix_millis(F.col(time).cast("timestamp")) / tick_ms).cast("bigint")
    return df.withColumn("_tick", tick)


def allowances(
    df: DataFrame,
    *,
    key: str,
    capacity: int,
    fill: int,
    tick_ms: int,
    time: str = "timestamp",
    block: int = BLOCK,
    buckets: DataFrame | None = None,
) -> DataFrame:
    """Per key and non-empty tick: rows ``n``, how many of them pass (``allowed``) and the level ``left``.

    ``buckets`` (key, level, tick) are levels an earlier run left behind; other keys start full.
    """
    counts = _ticks(df, key, time, tick_ms).groupBy(key, "_tick").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("_block", F.floor(F.col("_tick") / block).cast("bigint"))
    cap, rate = F.lit(capacity).cast("bigint"), F.lit(fill).cast("bigint")
    entry = F.struct(F.col("_tick").alias("tick"), F.col("n").alias("n"))
    # at most `block` entries: one per tick
    runs = counts.groupBy(key, "_block").agg(F.array_sort(F.collect_list(entry)).alias("ticks"))
    first, last = F.get("ticks", F.lit(0))["tick"], F.element_at("ticks", -1)["tick"]

    def compose(acc: Column, t: Column) -> Column:
        """The level after a tick's rows, as a function of the level at the block's first tick before any row."""
        gain = (t["tick"] - acc["tick"]) * rate
        lift = lambda x: F.least(x + gain, cap)  # noqa: E731  refill
        take = lambda x: F.greatest(x - t["n"], F.lit(0).cast("bigint"))  # noqa: E731  rows
        shift = acc["shift"] + gain - t["n"]
        return F.struct(
            t["tick"].alias("tick"), shift.alias("shift"), take(lift(acc["floor"])).alias("floor"), take(lift(acc["top"])).alias("top")
        )

    identity = F.struct(
        first.alias("tick"), F.lit(0).cast("bigint").alias("shift"), F.lit(0).cast("bigint").alias("floor"), cap.alias("top")
    )
    runs = runs.withColumns({"_first": first, "_last": last, "_effect": F.aggregate("ticks", identity, compose)})
    levels = [runs.select(key, F.col("_block").alias("_node"), "_first", "_last", "_effect")]
    for _ in range(LEVELS):
        levels.append(_runs_of(levels[-1], key, block, rate, cap))
    top = levels[-1]
    # the few entries that are left of a key
    chain = top.groupBy(key).agg(F.array_sort(F.collect_list(_child())).alias("_children"))
    if buckets is None:
        chain = chain.withColumns({"_level": cap, "_tick": F.lit(None).cast("bigint")})
    else:
        before = buckets.select(key, F.col("level").alias("_level"), F.col("tick").alias("_tick"))
        chain = chain.join(before, key, "left").withColumn("_level", F.coalesce("_level", cap))
    entries = _entries(chain, key, rate, cap, F.col("_tick"))
    for below, above in zip(levels[-2::-1], levels[:0:-1], strict=True):
        inside = above.select(key, "_node", "_children").join(entries, [key, "_node"])
        # the first child begins with its parent
        entries = _entries(inside, key, rate, cap, F.get("_children", F.lit(0))["first"])
    entries = entries.withColumnRenamed("_node", "_block")

    def spend(acc: Column, t: Column) -> Column:
        level = F.least(acc["level"] + (t["tick"] - acc["tick"]) * rate, cap)
        passed = F.least(level, t["n"])
        out = F.concat(acc["out"], F.array(F.struct(t["tick"].alias("tick"), t["n"].alias("n"), passed.alias("allowed"), (level - passed).alias("left"))))
        return F.struct((level - passed).alias("level"), t["tick"].alias("tick"), out.alias("out"))

    begin = F.struct(
        F.col("_level").alias("level"), F.col("_first").alias("tick"), F.array().cast("array<struct<tick:bigint,n:bigint,allowed:bigint,left:bigint>>").alias("out")
    )
    return (
        runs.join(entries, [key, "_block"])
        .select(key, F.explode(F.aggregate("ticks", begin, spend, lambda a: a["out"])).alias("t"))
        .select(key, F.col("t.tick").alias("_tick"), F.col("t.n").alias("n"), F.col("t.allowed").alias("allowed"), F.col("t.left").alias("left"))
    )


def _child() -> Column:
    """A node as an entry of its parent; in order of time."""
    return F.struct(F.col("_node").alias("node"), F.col("_first").alias("first"), F.col("_last").alias("last"), F.col("_effect").alias("f"))


def _clamped(x: Column, f: Column) -> Column:
    """The level after a node's ticks, or a bound of it, from the level at its first one."""
    return F.least(f["top"], F.greatest(f["floor"], x + f["shift"]))


def _runs_of(nodes: DataFrame, key: str, block: int, rate: Column, cap: Column) -> DataFrame:
    """Nodes of ``block`` nodes: their children, first and last tick, and effect."""
    parents = nodes.withColumn("_parent", F.floor(F.col("_node") / block).cast("bigint")).groupBy(key, "_parent").agg(F.array_sort(F.collect_list(_child())).alias("_children"))
    first = F.get("_children", F.lit(0))

    def compose(acc: Column, c: Column) -> Column:
        gain = (c["first"] - acc["last"]) * rate
        floor, top = (_clamped(F.least(acc["f"][x] + gain, cap), c["f"]) for x in ("floor", "top"))
        return F.struct(c["last"].alias("last"), F.struct((acc["f"]["shift"] + gain + c["f"]["shift"]).alias("shift"), floor.alias("floor"), top.alias("top")).alias("f"))

    effect = lambda f: F.struct(f["shift"].alias("shift"), f["floor"].alias("floor"), f["top"].alias("top"))
    begin = F.struct(first["last"].alias("last"), effect(first["f"]).alias("f"))
    rest = F.slice("_children", F.lit(2), F.size("_children"))
    folded = parents.withColumn("_folded", F.aggregate(rest, begin, compose))
    return folded.select(key, F.col("_parent").alias("_node"), "_children", first["first"].alias("_first"), F.col("_folded.last").alias("_last"), F.col("_folded.f").alias("_effect"))


def _entries(parents: DataFrame, key: str, rate: Column, cap: Column, since: Column) -> DataFrame:
    """The level on entry of each child: key, _node, _level. ``_level`` of a parent is its level at the tick ``since``, null for one that is full."""

    def enter(acc: Column, c: Column) -> Column:
        # rows older than the bucket's tick find the level as it is
        gap = F.greatest(F.coalesce(c["first"] - acc["last"], F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
        level = F.least(acc["level"] + gap * rate, cap)
        out = F.concat(acc["out"], F.array(F.struct(c["node"].alias("node"), level.alias("level"))))
        return F.struct(_clamped(level, c["f"]).alias("level"), F.greatest(c["last"], acc["last"]).alias("last"), out.alias("out"))

    start = F.struct(F.col("_level").alias("level"), since.alias("last"), F.array().cast("array<struct<node:bigint,level:bigint>>").alias("out"))
    return parents.select(key, F.explode(F.aggregate("_children", start, enter, lambda a: a["out"])).alias("e")).select(key, F.col("e.node").alias("_node"), F.col("e.level").alias("_level"))


def rate_limit(
    df: DataFrame,
    *,
    key: str = "service",
    capacity: int,
    fill: int,
    tick_ms: int = 1000,
    time: str = "timestamp",
    order: tuple[str, ...] = ("timestamp", "id"),
    buckets: DataFrame | None = None,
) -> DataFrame:
    """The rows that pass: in each tick the first ``allowed`` ones of the key."""
    allowed = allowances(df, key=key, capacity=capacity, fill=fill, tick_ms=tick_ms, time=time, buckets=buckets)
    return passing(df, allowed, key=key, capacity=capacity, tick_ms=tick_ms, time=time, order=order)


def passing(df: DataFrame, allowed: DataFrame, *, key: str, capacity: int, tick_ms: int, time: str, order: tuple[str, ...]) -> DataFrame:
    # no tick passes more than the capacity
    ranked = first_rows(_ticks(df, key, time, tick_ms), [key, "_tick"], list(order), capacity, "_n")
    return ranked.join(allowed.select(key, "_tick", "allowed"), [key, "_tick"]).filter(F.col("_n") <= F.col("allowed")).drop("_tick", "_n", "allowed")


def levels(allowed: DataFrame, key: str, buckets: DataFrame | None = None) -> DataFrame:
    """Bucket levels after a run, for the next one: key, level, tick. Keys without rows keep theirs."""
    last = allowed.groupBy(key).agg(F.max_by("left", "_tick").alias("level"), F.max("_tick").alias("tick"))
    if buckets is None:
        return last
    old = buckets.select(key, F.col("level").alias("_l"), F.col("tick").alias("_t"))
    joined = last.join(old, key, "full_outer")
    return joined.select(key, F.coalesce("level", "_l").alias("level"), F.greatest("tick", "_t").alias("tick"))
