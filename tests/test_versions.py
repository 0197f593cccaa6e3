"""Rule versions as tables against the same versions in the plan."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F
from test_rule_index import kept, some_condition

from logweir.operators import versions as V
from logweir.operators.rules import Options
from logweir.schemas import RULE_VERSION
from logweir.sources import views

FOLDER = "/root/testdata/sf0.001"


def version_rows(seed, rules, each):
    rng = random.Random(seed)
    out = []
    for r in range(rules):
        start = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randint(-24, 48))
        for v in range(each):
            action = rng.choice([["drop"], ["keep"], ["sample"]])
            doc = {"id": f"r{r}", "name": "r", "enabled": rng.random() < 0.8, "condition": some_condition(rng), "actions": [{"type": a, "config": {"rate": 0.5} if a == "sample" else {}} for a in action]}
            out.append((f"r{r}-{v}", f"r{r}", v, json.dumps(doc), "me", "", start))
            start += datetime.timedelta(hours=rng.randint(0, 200), microseconds=rng.choice([0, 5]))
    return out




@pytest.mark.parametrize("seed", range(3))
def test_same_decisions_as_versions_in_the_plan(spark, seed):
    logs = views.logs(spark, FOLDER).limit(400)
    table = spark.createDataFrame(version_rows(seed, 4, 4), RULE_VERSION)
    options = Options(seed=seed)
    got = V.apply_versions(logs, V.index_versions(table, logs, options), options, drop=False)
    assert kept(got) == kept(V.apply_as_of(logs, V.in_force(table), options, drop=False))


def test_many_versions_and_bad_ones(spark):
    logs = views.logs(spark, FOLDER)
    start = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("id") * 26)
    # 100,000 versions of one rule: each drops the level of its turn, for 26 seconds
    level = F.element_at(F.array(*map(F.lit, ("ERROR", "INFO", "WARN", "DEBUG"))), (F.col("id") % 4 + 1).cast("int"))
    body = F.concat(F.lit('{"id":"one","name":"n","enabled":true,"actions":[{"type":"drop"}],"condition":{"field":"level","operator":"eq","value":"'), level, F.lit('"}}'))
    many = spark.range(100_000).select(F.lit("one").alias("rule_id"), F.col("id").alias("version"), body.alias("content"), start.alias("created_at"))
    bad = [("bad", 1, "no JSON", datetime.datetime(2024, 1, 1)), ("mark", 1, '{"id":"mark","enabled":true,"condition":{},"actions":[{"type":"mark"}]}', datetime.datetime(2024, 1, 1)), ("one", 10**6, "[1]", datetime.datetime(2024, 1, 29))]
    index = V.index_versions(many.unionByName(spark.createDataFrame(bad, "rule_id string, version long, content string, created_at timestamp")), logs)
    assert {(r.rule_id, r.version) for r in index.rejected.collect()} == {("bad", 1), ("mark", 1), ("one", 10**6)}
    # the plan has no version in it
    few = V.index_versions(many.limit(3), logs)
    lines = [len(V.apply_versions(logs, i)._jdf.queryExecution().optimizedPlan().toString().splitlines()) for i in (index, few)]
    assert lines[0] == lines[1]
    turn = F.floor((F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6 - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 26)
    last = F.floor(F.lit(28 * 86400) / 26)
    own = F.element_at(F.array(*map(F.lit, ("ERROR", "INFO", "WARN", "DEBUG"))), (turn % 4 + 1).cast("int"))
    # the unusable version ends the one before it, until the next one starts
    blocked = (turn == last) & (F.col("timestamp").cast("timestamp") >= F.lit("2024-01-29 00:00:00").cast("timestamp"))
    want = logs.filter((own != F.col("level")) | blocked | (turn > 99_999)).select("id")
    got = V.apply_versions(logs, index).select("id")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_no_versions(spark):
    logs = views.logs(spark, FOLDER)
    assert V.apply_versions(logs, V.index_versions(spark.createDataFrame([], RULE_VERSION), logs)).count() == logs.count()


def test_versions_of_one_file_are_compiled_by_many_tasks(spark):
    """However few files hold a version table, all tasks compile it; parts of texts, numbers and versions in one moment are found as before."""
    logs = views.logs(spark, FOLDER).limit(300)
    table = spark.createDataFrame(version_rows(11, 40, 5), RULE_VERSION).coalesce(1)
    index = V.index_versions(table, logs)
    assert len(index.versions.inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert kept(V.apply_versions(logs, index, drop=False)) == kept(V.apply_as_of(logs, V.in_force(table), drop=False))
