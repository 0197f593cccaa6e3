"""Search that reads only the blocks of a log table that can hold the text.

The table is kept in blocks of time, and beside it is a table of signatures: which runs of three characters occur in which block and column. A text can
only be in a block that has all of its runs; the others are never opened, and every row of those that are left is still compared with the text.

Both are written batch by batch as logs arrive, signatures first, so rows are never there without them; a batch that runs again replaces its own folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweir.operators.query import search

RUN = 3
SECONDS = 3600
_NO_TIME = -(1 << 62)  # the block of rows without a time


def runs_of(text: Column) -> Column:
    """The different runs of three characters in a text, in lower case; none in shorter texts."""
    # one pass: a position that matches nothing but looks ahead
    return F.array_distinct(F.regexp_extract_all(F.lower(text.cast("string")), F.lit(rf"(?s)(?=(.{{{RUN}}}))"), 1))


def signatures(logs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``, ``run``, ``block``: one row for each run of a column in a block, whatever the number of rows that have it."""
    each = [F.struct(F.lit(c).alias("column"), runs_of(F.col(c)).alias("runs")) for c in columns]
    return logs.select("block", F.inline(F.array(*each))).select("block", "column", F.explode("runs").alias("run")).distinct()


def append(logs: DataFrame, path: str, batch: int, *, columns: Sequence[str] = ("message",), seconds: int = SECONDS, time: str = "timestamp") -> None:
    """Add a batch of logs and its signatures over ``columns``, the ones that can be searched."""
    root = path.rstrip("/")
    placed = logs.withColumn("block", F.coalesce(F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds), F.lit(_NO_TIME)).cast("bigint"))
    # in order of runs, so that a look-up skips what lies outside its runs by the files' own statistics
    signatures(placed, columns).sort("column", "run").write.mode("overwrite").parquet(f"{root}/signatures/batch={batch}")
    placed.write.mode("overwrite").partitionBy("block").parquet(f"{root}/rows/batch={batch}")


def blocks_for(spark: SparkSession, path: str, text: str, columns: Sequence[str] = ("message",)) -> DataFrame | None:
    """``batch`` and ``block`` of the blocks where some column has all runs of the text; None for texts too short to have one."""
    asked = [r.run for r in spark.range(1).select(F.explode(runs_of(F.lit(text))).alias("run")).collect()]
    if not asked:
        return None
    table = spark.read.parquet(f"{path.rstrip('/')}/signatures")
    hits = table.filter(F.col("column").isin(list(columns)) & F.col("run").isin(asked)).groupBy("batch", "block", "column").agg(F.count(F.lit(1)).alias("n"))
    return hits.filter(F.col("n") == len(asked)).select("batch", "block").distinct()


def candidates(spark: SparkSession, path: str, text: str, columns: Sequence[str] = ("message",)) -> DataFrame:
    """The rows of those blocks. Blocks are folders, and the join prunes them before they are listed for reading."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/rows")
    blocks = blocks_for(spark, path, text, columns)
    return rows if blocks is None else rows.join(blocks, ["batch", "block"], "left_semi")


def search_indexed(spark: SparkSession, path: str, text: str, *, columns: Sequence[str] = ("message",), limit: int | None = None, offset: int = 0, **where) -> DataFrame:
    """``query.search`` over a table with signatures: the same page and total. ``columns`` must be among those that the signatures were made of."""
    if not text:
        raise ValueError("search needs a text")
    return search(candidates(spark, path, text, columns).drop("batch", "block"), text, columns=columns, limit=limit, offset=offset, **where)
