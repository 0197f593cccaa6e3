"""Registered queries: a Spark job over a data folder, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweir.session import configure

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    job: Job
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def add(job: Job) -> Job:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return job(configure(spark), folder)

        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = Query(run, sql)
        return job

    return add


def time_text(col: str | Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def json_field(key: str, fields: str = "fields") -> Column:
    """Text of a top-level dynamic field."""
    return F.try_element_at(F.col(fields), F.lit(key)).cast("string")
