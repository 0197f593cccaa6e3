"""Rules as tables against the same rules compiled into a plan."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import rule_index
from logweir.operators.model import Rule
from logweir.operators.rules import Options, apply_rules
from logweir.schemas import DYNAMIC
from logweir.sources import stores, views

FOLDER = "/root/testdata/sf0.001"
FIELDS = ["level", "service", "message", "duration_ms", "line_number", "k", "fields.k", "user_id", "missing", "k.deeper", "odd", "flag"]
VALUES = ["ERROR", "INFO", "api-gateway", "timeout", "GET", "ms", "5", 5, 7.0, 20, "20", 1000.5, True, None, "", "u_1", "NaN", float("inf"), "<nil>", "/api/v1", "x", -0.0, 1e21]
OPERATORS = ["eq", "ne", "neq", "gt", "lt", "ge", "le", "contains", "starts_with", "ends_with", "matches", "in", "not_in", "exists", "not_exists", "unheard_of"]


def some_condition(rng, depth=0):
    kind = rng.random()
    if depth < 3 and kind < 0.25:
        return {"all": [some_condition(rng, depth + 1) for _ in range(rng.randint(1, 3))]}
    if depth < 3 and kind < 0.45:
        return {"any": [some_condition(rng, depth + 1) for _ in range(rng.randint(1, 3))]}
    if depth < 3 and kind < 0.55:
        return {"not": some_condition(rng, depth + 1)}
    op = rng.choice(OPERATORS)
    value = rng.choice(VALUES)
    if op in ("in", "not_in"):
        value = rng.choice([[], "no list", [rng.choice(VALUES) for _ in range(3)]])
    if op == "matches":
        value = rng.choice([r"^GET|POST", r"\d{3}ms$", "(?=x)", "time.*10", 5, "ERR"])
    return {"field": rng.choice(FIELDS), "operator": op, "value": value}


def some_rules(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        actions = rng.choice([["drop"], ["keep"], ["sample"], ["sample", "sample"], ["sample", "drop"], []])
        doc = {
            "id": f"r{rng.randint(0, 10**6):06d}-{i}", "name": "r", "enabled": rng.random() < 0.9, "condition": some_condition(rng),
            "actions": [{"type": a, "config": {"rate": rng.choice([0.2, 0.7])} if a == "sample" else {}} for a in actions],
        }
        out.append(Rule.parse(doc))
    return out


@pytest.fixture(scope="module")
def logs(spark):
    rows = views.logs(spark, FOLDER).limit(300)
    odd = [
        (1, "ERROR", "NaN timeout", float("nan"), '{"k": null, "odd": "5", "flag": true}'), (2, None, None, None, None), (3, "5", "", -0.0, '{"k": "7", "odd": {"a": 1}}'),
        (4, "INFO", "GET", float("inf"), '{"k": 1e21, "odd": [1, "x"], "flag": "NaN"}'), (4, "INFO", "GET", float("inf"), '{"k": 1e21}'), (None, "x", "time to 10", 5.0, '{"k": {"deeper": 20}}'),
        (5, "error", "ms", 1000.5, '{"k": -0.0, "odd": "", "flag": false}'),
    ]
    few = rows.sparkSession.createDataFrame(odd, "id long, level string, message string, duration_ms double, fields_json string")
    more = few.withColumn("fields", F.from_json("fields_json", DYNAMIC))
    return rows.unionByName(more, allowMissingColumns=True)


def kept(df):
    return sorted((str(r.id), str(r.message), r.rule_keep) for r in df.select("id", "message", "rule_keep").collect())


@pytest.mark.parametrize("seed", range(6))
def test_same_decisions_as_compiled_rules(spark, logs, seed):
    """Small sets, so that the rows left undecided by earlier rules meet the later ones."""
    for part in range(4):
        rules = some_rules(6, 100 * seed + part)
        options = Options(seed=seed)
        index = rule_index.build(spark, rules, logs, options)
        assert kept(rule_index.apply_index(logs, index, options, drop=False)) == kept(apply_rules(logs, rules, options, drop=False)), [json.dumps(r.to_doc()) for r in rules]


def large_set(n):
    return [
        Rule.parse({"id": f"r{i:06d}", "name": "r", "enabled": True, "actions": [{"type": "drop" if i % 3 else "keep"}],
                    "condition": {"all": [{"field": "user_id", "operator": "eq", "value": f"u_{i}"}, {"field": "message", "operator": "contains", "value": f"{i % 10}ms"}]}})
        for i in range(n)
    ]


def nodes(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(plan.splitlines()), len(plan)


def test_the_plan_does_not_grow_with_the_rules(spark, logs):
    small, large = (rule_index.build(spark, large_set(n), logs) for n in (10, 5000))
    assert large.programs.count() == 5000
    few, many = (rule_index.apply_index(logs, i) for i in (small, large))
    assert nodes(few)[0] == nodes(many)[0] and abs(nodes(few)[1] - nodes(many)[1]) < 200
    # 5,000 rules decide as compiled ones on a subset that holds every rule some row can match
    users = {r.user_id for r in logs.select("user_id").distinct().collect()}
    subset = [r for r in large_set(5000) if r.condition.all[0].value in users]
    assert len(subset) <= 200
    assert kept(rule_index.apply_index(logs, large, drop=False)) == kept(apply_rules(logs, subset, drop=False))


def test_candidates_are_few(spark, logs):
    """A rule is tried only on rows that have its most selective value."""
    index = rule_index.build(spark, large_set(5000), logs)
    rows = rule_index._sealed(logs, index, Options())
    asked = rows.select(F.explode(rule_index._row_keys(index, F.col("_facts"))).alias("key"))
    assert asked.join(index.postings, "key").count() <= logs.count()


def test_what_an_index_does_not_hold(spark, logs):
    mark = Rule.parse({"id": "m", "name": "m", "enabled": True, "condition": {"field": "level", "operator": "exists"}, "actions": [{"type": "mark"}]})
    with pytest.raises(ValueError):
        rule_index.build(spark, [mark], logs)
    with pytest.raises(ValueError):
        rule_index.build(spark, [], logs, Options(compat=True))
    none = rule_index.build(spark, [], logs)
    assert rule_index.apply_index(logs, none).count() == logs.count()


def test_a_rule_table_is_compiled_by_the_tasks(spark, logs, monkeypatch):
    """Of two rules with one key the later row stands, also if it is disabled; no rule comes to the driver."""
    rules = [*some_rules(12, 77), *some_rules(12, 78)]
    docs = [(r.id, f"s{i % 3}", json.dumps(r.to_doc())) for i, r in enumerate(rules)]
    docs += [(d[0], d[1], json.dumps(json.loads(d[2]) | {"enabled": i % 2 == 0, "actions": [{"type": "keep"}]})) for i, d in enumerate(docs[:6])]
    docs += [("x", None, '{"id":5,"enabled":true}'), ("m", None, '{"id":"m","enabled":true,"condition":{"field":"level","operator":"exists"},"actions":[{"type":"mark"}]}')]
    store = spark.createDataFrame(docs, "id string, scope string, body string").coalesce(1)
    usable = stores.load_rules(store.filter("id not in ('x', 'm')"))
    monkeypatch.setattr(rule_index, "in_order", None)
    index = rule_index.build_table(stores.documents(store), logs)
    assert {json.loads(r.body)["id"] for r in index.rejected.collect()} == {5, "m"}
    assert kept(rule_index.apply_index(logs, index, drop=False)) == kept(apply_rules(logs, usable, drop=False))
    none = rule_index.build_table(stores.documents(store.limit(0)), logs)
    assert rule_index.apply_index(logs, none).count() == logs.count()


def test_the_query_holds_no_rule_in_the_driver(spark, monkeypatch):
    from logweir.plans import rules_catalog

    monkeypatch.setattr(rule_index, "build", None)
    monkeypatch.setattr(stores, "load_rules", None)
    assert rules_catalog.rules_indexed(spark, FOLDER).count() > 0
