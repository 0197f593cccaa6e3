"""Sinks: document upsert by id, several targets at once, alert feed, topic, console."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from logweir.schemas import DOCUMENT

log = logging.getLogger(__name__)


def document_id(service: Column, timestamp: Column, raw: Column | None = None) -> Column:
    """``service-nanoseconds-hash of the line``; without a line, service and nanoseconds alone.

    Times of lines often are whole seconds, so service and time don't tell two lines apart.
    """
    parts = [service, (F.unix_micros(timestamp.cast("timestamp")) * 1000).cast("string")]
    if raw is not None:
        parts.append(F.substring(F.sha2(raw, 256), 1, 16))
    return F.concat_ws("-", *parts)


def documents(enriched: DataFrame) -> DataFrame:
    """Enriched logs in the shape of the indexed document, with its id."""
    columns = [F.col(f.name) for f in DOCUMENT.fields if f.name in enriched.columns]
    raw = F.col("raw") if "raw" in enriched.columns else None
    return enriched.select(document_id(F.col("service"), F.col("timestamp"), raw).alias("id"), *columns)


def latest_per_id(docs: DataFrame, order: Column, key: str = "id") -> DataFrame:
    """One document per id, the last written; a hash aggregate, so repeated ids collapse before the shuffle."""
    rest = [c for c in docs.columns if c != key]
    last = docs.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_doc"))
    return last.select(key, "_doc.*")


def upsert(docs: DataFrame, path: str, order: Column, batch: int) -> None:
    """Write a batch of documents so that a repeated id overwrites: ``current`` reads each id's newest one.

    A batch has a folder of its own and touches no other, so it costs what it holds, readers never see half of it,
    and a repeated batch overwrites itself. Within a batch the last by ``order`` stands.
    """
    fresh = latest_per_id(docs, order).withColumn("date", F.to_date("timestamp"))
    fresh.write.mode("overwrite").partitionBy("date").parquet(f"{path}/batch={batch}")


def _newest(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("id", "date", "batch")]
    newest = rows.groupBy("date", "id").agg(F.max_by(F.struct(*rest), "batch").alias("_doc"))
    return newest.select("id", "_doc.*", "date")


def current(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The documents of all batches, each id's newest. A filter on ``date`` prunes: an id's documents share their time."""
    if schema is None:
        return _newest(spark.read.parquet(path))
    whole = StructType([*schema, StructField("batch", LongType()), StructField("date", DateType())])
    return _newest(spark.read.schema(whole).parquet(path))


def compact(spark: SparkSession, path: str, target: str, batch: int) -> None:
    """All batches up to ``batch`` as one, in another folder, to be read in their place."""
    rows = _newest(spark.read.parquet(path).filter(F.col("batch") <= batch))
    rows.repartition("date", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("date").parquet(f"{target}/batch={batch}")


def alert_feed(docs: DataFrame) -> DataFrame:
    """ERROR and FATAL documents as JSON rows; delivery is the caller's."""
    failed = docs.filter(F.col("level").isin("ERROR", "FATAL"))
    return failed.select(F.to_json(F.struct(*failed.columns)).alias("body"))


def encode(logs: DataFrame, extra: tuple[str, ...] = ("cluster", "pod", "trace_id", "span_id"), fields: str = "fields") -> Column:
    """One JSON object per log entry: header, optional columns that are not empty, dynamic fields."""
    header = [F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("level"), F.col("message"), F.col("service")]
    optional = [F.nullif(F.col(c), F.lit("")).alias(c) for c in extra if c in logs.columns]
    head = F.to_json(F.struct(*header, *optional))
    if fields not in logs.columns:
        return head
    # null columns are left out; the dynamic fields are joined on as text
    tail = F.to_json(F.col(fields))
    joined = F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(","), F.substring(tail, 2, 2**31 - 1))
    return F.when(F.coalesce(F.size(fields), F.lit(0)) > 0, joined).otherwise(head)


def topic_rows(logs: DataFrame) -> DataFrame:
    """``key`` (service) and ``value`` for a topic."""
    return logs.select(F.col("service").alias("key"), encode(logs).alias("value"))


def write_topic(logs: DataFrame, brokers: str, topic: str) -> None:
    """Needs the Kafka connector jar."""
    topic_rows(logs).write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).save()


def write_console(docs: DataFrame, index: str, emit: Callable[[str], object] = print) -> None:
    """Print every document from the task that holds it: in a local session to this console's error output, on a cluster to the executors'."""
    lines = docs.select(F.concat(F.lit(f"[{index}] "), F.to_json(F.struct(*docs.columns))).alias("document"))

    def show(rows) -> None:
        for row in rows:
            emit(row.document)

    lines.foreachPartition(show)


def write_all(docs: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> Exception | None:
    """Give the rows to every sink, computed once. A failing sink does not stop the others; the last error is returned."""
    docs = docs.persist()
    last = None
    try:
        for sink in sinks:
            try:
                sink(docs)
            except Exception as err:  # noqa: BLE001
                log.error("sink %s failed: %s", getattr(sink, "__name__", sink), err)
                last = err
    finally:
        docs.unpersist()
    return last
