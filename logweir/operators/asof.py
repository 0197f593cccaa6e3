"""As-of joins: for each row the latest of another table's rows that is not later than it.

Both sides are laid out by key and block of time and sorted together; within a block the last value seen is carried along. What a block needs from the
blocks before it is one value for each key and block, found on a table of blocks and added to the block as its first row. Very many rows of one key and
block are dealt to ``SALTS`` parts that each hold the block's values, so neither a key nor a moment with a third of all rows is one task's burden. Values
go only to the parts that rows are in: once to a block of few rows, to none without rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SALTS = 16
HOT = 20_000  # rows of one key and block
BLOCK = 86_400  # seconds


def _holds_map(kind: T.DataType) -> bool:
    """Maps and variants can't be hashed."""
    return any(word in kind.simpleString() for word in ("map<", "variant"))


def _laid_out(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: Column, right_time: Column, order: Sequence[str], block: int) -> DataFrame:
    """Rows of ``left`` (``_kind`` 2) by key, block and salt, with the values that they need: those of the block (1) and the last one before it (0)."""
    keys = list(by)

    def placed(df: DataFrame, time: Column) -> DataFrame:
        micros = F.unix_micros(time.cast("timestamp"))
        return df.withColumns({"_at": micros, "_block": F.floor(micros / (block * 1_000_000)).cast("bigint")})

    rest = [c for c in right.columns if c not in keys]
    # by what the row holds, so that a task that runs again deals its rows as before
    plain = [c for c in left.columns if not _holds_map(left.schema[c].dataType)]
    own = placed(left, left_time).withColumn("_part", F.pmod(F.xxhash64("_at", *plain), F.lit(SALTS)).cast("int"))
    parts = [*keys, "_block", "_part"]

    def salt(rows: Column) -> Column:
        """A part of very many rows stands for itself, the others of a key and block stay together."""
        return F.when(rows > HOT // SALTS, F.col("_part")).otherwise(SALTS).alias("_salt")

    values = placed(right, right_time).filter("_at is not null").select(*keys, "_block", "_at", F.struct("_at", *order).alias("_place"), F.struct(*rest).alias("_value"))
    # the last value of each block, and the last one before each block that rows are in
    ends = values.groupBy(*keys, "_block").agg(F.max_by("_value", "_place").alias("_end"))
    counted = own.filter("_at is not null").groupBy(*parts).agg(F.count(F.lit(1)).alias("_rows"))
    salts = counted.select(*keys, "_block", salt(F.col("_rows"))).groupBy(*keys, "_block").agg(F.collect_set("_salt").alias("_salts"))
    blocks = ends.unionByName(salts, allowMissingColumns=True).groupBy(*keys, "_block").agg(F.first("_end", ignorenulls=True).alias("_end"), F.first("_salts", ignorenulls=True).alias("_salts"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_value", F.last("_end", ignorenulls=True).over(earlier)).filter("_salts is not null and _value is not null")
    everywhere = F.explode("_salts").alias("_salt")
    none = F.lit(None).cast(values.schema["_place"].dataType).alias("_place")
    asking = F.first("_salts", ignorenulls=True).over(Window.partitionBy(*keys, "_block"))
    told = values.unionByName(salts, allowMissingColumns=True).withColumn("_salts", asking).filter("_at is not null")
    told = told.select(*keys, "_block", "_at", "_place", "_value", F.lit(1).alias("_kind"), everywhere)
    told = told.unionByName(carried.select(*keys, "_block", F.lit(None).cast("bigint").alias("_at"), none, "_value", F.lit(0).alias("_kind"), everywhere))
    row = F.struct(*[c for c in left.columns if c not in keys]).alias("_row")
    together = F.count(F.lit(1)).over(Window.partitionBy(*parts))
    asked = own.withColumn("_rows", together).select(*keys, "_block", "_at", none, row, F.lit(2).alias("_kind"), salt(F.col("_rows")))
    return asked.unionByName(told, allowMissingColumns=True)


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: Column, right_time: Column, order: Sequence[str] = (), *, value: str = "value", block: int = BLOCK) -> DataFrame:
    """The rows of ``left`` with ``value``: the row of ``right`` with like ``by`` columns and the latest time up to the row's own; null if there is none.

    Of several with one time the last by ``order`` counts. Keys that are null meet like keys that are null; rows of ``right`` without a time take no part, rows of
    ``left`` without one get null. Both sides are read more than once.
    """
    keys = list(by)
    both = _laid_out(left, right, by, left_time, right_time, order, block)
    so_far = Window.partitionBy(*keys, "_block", "_salt").orderBy(F.asc_nulls_first("_at"), "_kind", F.asc_nulls_first("_place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(value, F.when(F.col("_at").isNotNull(), F.last("_value", ignorenulls=True).over(so_far))).filter("_kind = 2")
    return found.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in left.columns], value)
