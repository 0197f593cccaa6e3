"""Ingest of log entries: validation, the logs table, its layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweir.functions.fields import empty_fields
from logweir.schemas import DYNAMIC


def validate(entries: DataFrame) -> DataFrame:
    """Adds ``error``, null for a valid entry: the service is required, times and fields must be readable."""
    when = F.col("timestamp").try_cast("timestamp") if dict(entries.dtypes)["timestamp"] == "string" else F.col("timestamp")
    broken_fields = F.col("fields").isNotNull() & F.try_variant_get(F.try_parse_json("fields"), "$", "map<string,variant>").isNull()
    error = (
        F.when(F.coalesce("service", F.lit("")) == "", "service is required")
        .when(F.col("timestamp").isNotNull() & when.isNull(), "timestamp is not a time")
        .when(broken_fields, "fields is not an object")
    )
    return entries.withColumn("error", error)


def to_logs(entries: DataFrame, created_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows for the logs table, rejected entries with their error)."""
    checked = validate(entries)
    good = checked.filter("error is null").drop("error")
    good = good.withColumns(
        {
            "timestamp": F.col("timestamp").try_cast("timestamp"),
            "fields": F.coalesce(F.from_json("fields", DYNAMIC), empty_fields()),
            "created_at": F.current_timestamp() if created_at is None else created_at,
        }
    )
    return good, checked.filter("error is not null")


def append_logs(logs: DataFrame, path: str) -> None:
    """Append to the logs table: a folder per date, rows of a service next to each other inside a file.

    Date folders prune by time; sorted files let row-group statistics skip by service and level.
    """
    dated = logs.withColumn("date", F.to_date("timestamp"))
    dated.sortWithinPartitions("date", "service", "level").write.mode("append").partitionBy("date").parquet(path)
