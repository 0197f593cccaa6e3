"""Raw lines and training samples from files and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweir.schemas import TRAINING_SAMPLE


def kafka_options(
    brokers: str, topic: str, group: str = "", *, starting: str = "earliest", max_per_trigger: int | None = None, flush_rows: int | None = None, flush_seconds: int = 5,
    fail_on_data_loss: bool = True,
) -> dict[str, str]:
    """Reader options. With ``flush_rows`` a micro-batch starts once so many rows wait, or ``flush_seconds`` after the one before, whichever comes first."""
    options = {"kafka.bootstrap.servers": brokers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": str(fail_on_data_loss).lower()}
    if group:
        options["kafka.group.id"] = group
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    if flush_rows:
        options |= {"minOffsetsPerTrigger": str(flush_rows), "maxTriggerDelay": f"{flush_seconds}s"}
    return options


def stream_topic(spark: SparkSession, brokers: str, topic: str, **options) -> DataFrame:
    """``raw``, ``ingest_ts`` from a topic; offsets live in the query's checkpoint. Needs the Kafka connector jar."""
    rows = spark.readStream.format("kafka").options(**kafka_options(brokers, topic, **options)).load()
    return rows.select(F.col("value").cast("string").alias("raw"), F.col("timestamp").alias("ingest_ts"))


def stream_lines(spark: SparkSession, path: str, *, max_files: int | None = None, glob: str | None = None) -> DataFrame:
    """Lines of text files as they arrive in a folder."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("value").alias("raw"), F.current_timestamp().alias("ingest_ts"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("raw"))


def stream_table(spark: SparkSession, folder: str, name: str, *, max_files: int | None = None) -> DataFrame:
    """A parquet table of a folder as a stream."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def read_samples(spark: SparkSession, path: str, *, listed: bool = False) -> DataFrame:
    """Labelled lines: an object on each line, as ``write_samples`` stores them, or with ``listed`` one JSON list for each file."""
    return spark.read.schema(TRAINING_SAMPLE).json(path, multiLine=listed)


def write_samples(samples: DataFrame, path: str) -> None:
    samples.select("log", "expected_format", "source").write.mode("overwrite").json(path)
