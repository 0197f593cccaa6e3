"""The first rows of each group, whatever the size of the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from logweir.session import materialise

SALTS = 64
HOT = 100_000


def first_rows(df: DataFrame, by: list[str], order: list[str], limit: int, rank: str, descending: bool = False) -> DataFrame:
    """The first ``limit`` rows per group with their ``rank`` (from 1).

    Ranked twice: within a group and a salt, then within the group, so the second sort sees at most ``limit`` rows
    per salt of a group. Ranks are only as stable as ``order`` is total.
    """
    keys = [F.desc(c) if descending else F.asc(c) for c in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    plain = [F.col(c) for c in by]
    near = Window.partitionBy(*plain, "_salt").orderBy(*keys)
    far = Window.partitionBy(*plain).orderBy(*keys)
    return salted.withColumn(rank, F.row_number().over(near)).filter(F.col(rank) <= limit).drop("_salt").withColumn(rank, F.row_number().over(far)).filter(F.col(rank) <= limit)


def salted_join(rows: DataFrame, keys: DataFrame, on: str, how: str, salt: list[str], count: str) -> DataFrame:
    """Join many rows with keys so that the rows of one key go to many tasks: a key of more than ``HOT`` rows is there once per salt, others once.

    ``salt``: columns of the rows that tell them apart. ``count``: the column of the keys that says how many rows each has.
    """
    keys = materialise(keys, "join-keys")
    frequent = F.col(count) > HOT
    hot = F.broadcast(keys.filter(frequent).select(on, F.lit(True).alias("_hot")))  # at most rows / HOT
    many = rows.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    few = keys.withColumn("_salt", F.explode(F.when(frequent, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(count)
    # small as a file, but many times that in memory: keys grow with the rows and are never broadcast
    return many.join(few.hint("merge"), [on, "_salt"], how).drop("_salt")
