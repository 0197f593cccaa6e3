"""Timestamp texts of log lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})\z"
PLAIN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d+)?\z"


def parse_text(text: Column) -> Column:
    """RFC 3339 or ``yyyy-MM-dd HH:mm:ss`` with an optional fraction, else null."""
    return F.when(text.rlike(RFC3339) | text.rlike(PLAIN), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))


def parse_variant(value: Column) -> Column:
    """As ``parse_text``; a JSON number is a count of seconds."""
    text = F.try_variant_get(value, "$", "string")
    seconds = F.when(F.schema_of_variant(value) != "STRING", F.try_variant_get(value, "$", "double"))
    return F.coalesce(parse_text(text), F.timestamp_seconds(F.floor(seconds).cast("bigint")))


def parse_syslog(text: Column, year: Column) -> Column:
    """``MMM d HH:mm:ss``: the line carries no year."""
    tidy = F.initcap(F.regexp_replace(text, r"\s+", " "))
    return F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), tidy), F.lit("yyyy MMM d HH:mm:ss"))


def parse_access(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
