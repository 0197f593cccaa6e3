"""Search by signatures gives what the full search gives, and opens few blocks for a rare text."""

import pytest
from pyspark.sql import functions as F

from logweir.operators import search_index as X
from logweir.operators.query import search
from logweir.session import scratch

HOURS = 48


@pytest.fixture(scope="module")
def logs(spark):
    words = F.array(*[F.lit(w) for w in ("cache refreshed", "Käse ÜBER 100%", "line\nbreak", "quota of tenant", "🙂🙃 smiles", "")])
    out = spark.range(4800).select(
        "id",
        F.timestamp_seconds(F.col("id") * 36).cast("timestamp_ntz").alias("timestamp"),
        F.concat(F.get(words, (F.col("id") % 6).cast("int")), F.lit(" "), F.hex(F.col("id"))).alias("message"),
        F.concat(F.lit("pkg/"), (F.col("id") % 7).cast("string"), F.lit(".go")).alias("path"),
    )
    rare = spark.sql("select 9001 id, timestamp_ntz '1970-01-01 05:30:00' timestamp, 'Needle in hay' message, null path")
    odd = spark.sql("select * from values (9002, null, 'no time, a needle', 'x'), (9003, timestamp_ntz '1969-12-31 23:00:00', null, 'pkg/needle.go') as t(id, timestamp, message, path)")
    return out.unionByName(rare).unionByName(odd).coalesce(2)


@pytest.fixture(scope="module")
def path(spark, logs):
    path = scratch(spark, "index")
    late = F.coalesce(F.col("id") % 3 == 0, F.lit(False))
    X.append(logs.filter(~late), path, 0, columns=("message", "path"))
    for _ in range(2):  # a batch that runs again
        X.append(logs.filter(late), path, 1, columns=("message", "path"))
    return path


@pytest.mark.parametrize(
    "text, columns",
    [(t, ("message",)) for t in ("NEEDLE IN", "käse über", "e\nb", "🙂🙃", "🙃 s", "of", "absent words")] + [(t, ("message", "path")) for t in ("needle", "a", "100%")],
)
def test_same_as_the_full_search(spark, logs, path, text, columns):
    got = X.search_indexed(spark, path, text, columns=columns)
    wanted = search(logs, text, columns=columns)
    key = lambda rows: [(r.id, r.timestamp, r.message, r.path, r.total) for r in rows]
    assert got.columns == wanted.columns
    assert sorted(key(got.collect()), key=repr) == sorted(key(wanted.collect()), key=repr)


def test_pages_and_conditions(spark, logs, path):
    got = X.search_indexed(spark, path, "cache", limit=7, offset=3, start="1970-01-01 10:00:00").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in search(logs, "cache", limit=7, offset=3, start="1970-01-01 10:00:00").collect()]


def test_a_rare_text_opens_few_blocks(spark, path):
    blocks = X.blocks_for(spark, path, "needle in hay")
    everything = spark.read.parquet(f"{path}/rows").select("batch", "block").distinct().count()
    assert blocks.count() == 1 and everything > 10 * HOURS / 8
    rows = X.candidates(spark, path, "needle in hay")
    assert rows.count() <= 101
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_empty_text(spark, path):
    with pytest.raises(ValueError):
        X.search_indexed(spark, path, "")
