"""Message templates that outlive a batch, kept in a table of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweir.operators import mining

COLUMNS = "_key string, pattern string, frequency bigint"


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table after a batch (None: the last). A group keeps the template of its first batch; frequencies add up."""
    rows = spark.read.schema(f"{COLUMNS}, v bigint").parquet(path)
    if version is not None:
        rows = rows.filter(F.col("v") <= version)
    return rows.groupBy("_key").agg(F.min_by("pattern", "v").alias("pattern"), F.sum("frequency").alias("frequency"))


def absorb(batch: DataFrame, path: str, version: int) -> DataFrame:
    """Add a batch's groups to the table, in a folder of their own. Repeating a batch rewrites that folder only."""
    mining.groups(batch).select("_key", "pattern", "frequency").write.mode("overwrite").parquet(f"{path}/v={version}")
    return read(batch.sparkSession, path, version)


def start(logs: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None):
    """Keep the template table up to date from a stream; version n is the state after batch n."""

    def batch(df: DataFrame, number: int) -> None:
        absorb(df, path, number)

    writer = logs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def patterns(table: DataFrame) -> DataFrame:
    out = table.groupBy("pattern").agg(F.sum("frequency").alias("frequency"))
    return out.select(
        mining.pattern_id(F.col("pattern")).alias("id"), "pattern", "frequency", mining.severity(F.col("frequency")).alias("severity")
    )
