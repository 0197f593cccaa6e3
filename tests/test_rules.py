"""Rule semantics on small entries: operators, errors, actions, termination, edits."""

import json

import pytest
from pyspark.sql import functions as F

from logweir.functions.regex import InvalidPattern, glob_pattern, java_pattern
from logweir.operators.model import Condition, Rule, RuleError
from logweir.operators.rules import Options, apply_rules, audit_rows, evaluate_single, rule_stats
from logweir.schemas import DYNAMIC


def entries(spark, *docs):
    rows = [(i, json.dumps({k: v for k, v in d.items() if k not in ("level", "message")}), d.get("level"), d.get("message")) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "id long, doc string, level string, message string")
    return df.withColumn("fields", F.from_json("doc", DYNAMIC)).drop("doc")


def rule(id, condition, *actions, **more):
    return Rule.parse({"id": id, "name": id, "enabled": True, "condition": condition, "actions": [{"type": t, "config": c} for t, c in actions], **more})


def leaf(field, operator, value=None):
    return {"field": field, "operator": operator, "value": value}


def matched(spark, condition, *docs):
    out = evaluate_single(entries(spark, *docs), rule("r", condition))
    return [r.matched for r in out.orderBy("id").collect()]


@pytest.mark.parametrize(
    "operator, value, expected",
    [
        ("eq", 5, [True, True, False, False, False, False]),
        ("eq", "5", [True, True, False, False, False, False]),
        ("ne", 5, [False, False, True, True, True, True]),
        ("gt", 4, [True, True, True, False, True, True]),
        ("lt", "b", [True, True, True, True, False, False]),
        ("ge", 5, [True, True, True, False, True, True]),
        ("contains", "5", [True, True, False, False, False, False]),
        ("starts_with", "tr", [False, False, False, False, False, True]),
        ("in", [5, "abc"], [True, True, False, False, False, False]),
        ("not_in", [5, "x y"], [False, False, True, True, False, True]),
        ("exists", None, [True] * 6),
    ],
)
def test_operators_over_types(spark, operator, value, expected):
    docs = [{"v": 5}, {"v": "5.0"} if operator not in ("contains",) else {"v": "a5"}, {"v": 40}, {"v": None}, {"v": "x y"}, {"v": True}]
    # a null sorts below everything; true and text compare as text
    assert matched(spark, leaf("v", operator, value), *docs) == expected


def test_numbers_are_text_for_text_operators(spark):
    docs = [{"v": 1677585600}, {"v": 1234567}, {"v": 12.5}, {"v": 0.00001}, {"v": 7}]
    found = [matched(spark, leaf("v", "matches", p), d)[0] for p, d in zip((r"^1\.6775856e\+09$", r"^1\.234567e\+06$", r"^12\.5$", "^1e-05$", "^7$"), docs)]
    assert found == [True] * 5


def test_missing_field_and_not(spark):
    docs = [{"a": 1}, {}]
    assert matched(spark, leaf("a", "eq", 1), *docs) == [True, False]
    assert matched(spark, {"not": leaf("a", "eq", 1)}, *docs) == [False, True]
    assert matched(spark, leaf("a", "ne", 1), *docs) == [False, False]
    assert matched(spark, leaf("a.b.c", "not_exists"), {"a": {"b": {"c": None}}}, {"a": {"b": 1}}) == [False, True]


def test_broken_leaves_count_from_left_to_right(spark):
    bad, yes, no = leaf("a", "matches", "(?=x)"), leaf("a", "eq", 1), leaf("a", "eq", 2)
    doc = {"a": 1}
    for condition, expected in (
        ({"any": [yes, bad]}, True),
        ({"any": [bad, yes]}, False),
        ({"all": [no, bad]}, False),
        ({"not": bad}, False),
        ({"not": {"all": [no, bad]}}, True),
        ({"not": {"all": [bad, no]}}, False),
        (leaf("a", "nonsense", 1), False),
        (leaf("a", "in", 1), False),
        ({"not": leaf("missing", "nonsense", 1)}, True),
    ):
        assert matched(spark, condition, doc) == [expected], condition
    audited = apply_rules(entries(spark, doc), [rule("r", {"any": [bad, yes]})], Options(audit=True), drop=False)
    assert audited.collect()[0].rule_errors == 1


def test_precedence_and_validation():
    both = Condition.parse({"all": [leaf("a", "eq", 1)], "any": [leaf("b", "eq", 1)]})
    assert both.all and both.any
    for doc in ({}, leaf("a", "nope", 1), {"field": "a", "operator": "eq"}, {**leaf("a", "eq", 1), "not": leaf("a", "eq", 1)}):
        with pytest.raises(RuleError):
            Condition.parse(doc).validate()
    Condition.parse({"not": {"any": [leaf("a", "exists")]}}).validate()
    with pytest.raises(RuleError):
        Rule.parse("{broken")


def edited(spark, doc, *rules, **options):
    row = apply_rules(entries(spark, doc), list(rules), Options(**options)).select("level", "message", F.to_json("fields").alias("f")).collect()
    return [(r.level, r.message, json.loads(r.f)) for r in row]


ANY = leaf("id", "exists")


@pytest.mark.parametrize(
    "action, doc, expected",
    [
        (("mask", {"field": "password"}), {"password": "secret123"}, {"password": "*********"}),
        (("mask", {"field": "p", "pattern": r"\d+", "character": "#"}), {"p": "a12é345"}, {"p": "a##é###"}),
        (("mask", {"field": "p", "pattern": "é"}), {"p": "né"}, {"p": "n**"}),
        (("mask", {"field": "p"}), {"p": 5}, {"p": 5}),
        (("mask", {"field": "p", "pattern": "(?=x)"}), {"p": "x"}, {"p": "x"}),
        (("truncate", {"field": "p", "max_length": 3}), {"p": "abcdef"}, {"p": "abc..."}),
        (("truncate", {"field": "p", "max_length": 3, "suffix": ""}), {"p": "abéd"}, {"p": "ab"}),
        (("truncate", {"field": "p", "max_length": 6}), {"p": "abcdef"}, {"p": "abcdef"}),
        (("extract", {"source_field": "p", "target_field": "q.r", "pattern": r"(?P<k>\w+)=(\d+)", "group": 2}), {"p": "n=42"}, {"p": "n=42", "q": {"r": "42"}}),
        (("extract", {"source_field": "p", "target_field": "q", "pattern": "(z)"}), {"p": "n"}, {"p": "n"}),
        (("rename", {"from": "a", "to": "b.c"}), {"a": {"x": [1]}}, {"b": {"c": {"x": [1]}}}),
        (("rename", {"from": "a.x", "to": "a.y"}), {"a": {"x": 1, "z": 2}}, {"a": {"y": 1, "z": 2}}),
        (("rename", {"from": "gone", "to": "b"}), {"a": 1}, {"a": 1}),
        (("rename", {"from": "a", "to": "b.c"}), {"a": 1, "b": 2}, {"a": 1, "b": 2}),
        (("remove", {"field": "a.x", "fields": ["a.y", "b", "none.such"]}), {"a": {"x": 1, "y": 2, "z": 3}, "b": 1}, {"a": {"z": 3}}),
        (("set", {"field": "a.b.c", "value": {"deep": [1, None]}}), {"a": {"k": 1}}, {"a": {"k": 1, "b": {"c": {"deep": [1, None]}}}}),
        (("set", {"field": "a.b", "value": 1}), {"a": "text"}, {"a": "text"}),
        (("mark", {"value": "t", "reason": "r"}), {"_tags": "old"}, {"_tags": "t"}),
    ],
)
def test_actions(spark, action, doc, expected):
    assert edited(spark, doc, rule("r", ANY, action)) == [(None, None, expected)]


def test_standard_columns_and_shadowing(spark):
    rules = [rule("a", ANY, ("rename", {"from": "level", "to": "severity"}), ("set", {"field": "message", "value": "m"}))]
    assert edited(spark, {"level": "INFO", "message": "x"}, *rules) == [(None, "m", {"severity": "INFO"})]
    # a key of the map hides the column of the same name
    df = entries(spark, {"level": "INFO"}).withColumn("fields", F.from_json(F.lit('{"level":"ERROR"}'), DYNAMIC))
    drop = [rule("a", leaf("level", "eq", "ERROR"), ("drop", {}))]
    assert apply_rules(df, drop, Options(shadow=True)).count() == 0
    assert apply_rules(df, drop).count() == 1


def test_later_rules_see_edits_and_failures_do_not_stop_a_chain(spark):
    rules = [
        rule("1", ANY, ("set", {"field": "n", "value": 1}), ("nonsense", {}), ("set", {"field": "n.x", "value": 1}), ("set", {"field": "m", "value": 2})),
        rule("2", leaf("n", "eq", 1), ("set", {"field": "seen", "value": True})),
        rule("3", leaf("m", "eq", 3), ("drop", {})),
    ]
    assert edited(spark, {}, *rules) == [(None, None, {"n": 1, "m": 2, "seen": True})]
    audited = apply_rules(entries(spark, {}), rules, Options(audit=True), drop=False)
    first = audited.collect()[0].rule_audit[0]
    assert [a.success for a in first.actions] == [True, False, False, True]
    stats = rule_stats(apply_rules(entries(spark, {}), rules, Options(counters=True), drop=False)).collect()[0]
    assert (stats.total_evaluations, stats.matched_evaluations, stats.actions_executed, stats.failed_actions) == (3, 2, 5, 2)


def test_drop_ends_the_chain(spark):
    rules = [rule("001-drop-all", leaf("level", "exists"), ("drop", {})), rule("002-keep", leaf("level", "eq", "ERROR"), ("keep", {}))]
    df = entries(spark, {"level": "ERROR"}, {"level": "INFO"})
    audited = apply_rules(df, rules, Options(audit=True), drop=False)
    assert [r.rule_keep for r in audited.collect()] == [False, False]
    assert audit_rows(audited, "id").count() == 2
    assert apply_rules(df, rules).count() == 0
    # keys decide the order, not the list or the priority
    assert apply_rules(df, [rules[1], rule("000", leaf("level", "eq", "INFO"), ("keep", {}), priority=-1), rules[0]]).count() == 1


def test_sampling_rate_and_repeatability(spark):
    df = spark.range(1000).selectExpr("id", "'DEBUG' level", "cast(null as map<string,variant>) fields")
    r = [rule("s", leaf("level", "eq", "DEBUG"), ("sample", {"rate": 0.5}))]
    kept = apply_rules(df, r)
    assert 400 < kept.count() < 600
    assert sorted(x.id for x in kept.collect()) == sorted(x.id for x in apply_rules(df.repartition(7), r).collect())
    assert apply_rules(df, r, Options(seed=1)).count() != 0


def test_long_rule_sets_stay_plannable(spark):
    df = spark.range(100).selectExpr("id", "concat('m', id) message", "cast(null as map<string,variant>) fields")
    many = [rule(f"{i:04d}", leaf("message", "eq", f"m{i}"), ("drop", {})) for i in range(0, 400, 2)]
    assert apply_rules(df, [rule("0", leaf("id", "eq", -1), ("keep", {})), *many]).count() == 50
    edits = [rule(f"{i:04d}", leaf("message", "contains", "m"), ("truncate", {"field": "message", "max_length": 100 - i})) for i in range(12)]
    assert apply_rules(df, edits).filter("message like 'm9%'").count() == 11


def test_patterns():
    assert java_pattern("a$") == r"(?d)a\z"
    assert java_pattern("(?P<x_y>a)[[:alpha:]&[]") == r"(?d)(a)[\p{Alpha}\&\[]"
    for bad in ("(?=a)", "(?<!a)", r"(a)\1", "a++", "a**", "(", "[", r"\Z"):
        with pytest.raises(InvalidPattern):
            java_pattern(bad)
    assert glob_pattern("pkg/*.go") == r"(?s)\Apkg/[^/]*\.go\z"
