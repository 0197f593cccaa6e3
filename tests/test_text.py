"""Text analysis, enrichment and transforms on literal texts."""

import pytest
from pyspark.sql import functions as F

from logweir.operators import semantic as S, text as X
from logweir.operators.transform import TransformRule, TransformRules, transform_logs
from logweir.schemas import DYNAMIC


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    "text, score, label, mixed",
    [
        ("This is very good!", 0.75, "positive", False),
        ("not good", -0.25, "negative", False),
        ("The system failed with a terrible crash", -1.0, "negative", False),
        ("good but slow", 0.1, "neutral", True),
        ("not really good", -0.375, "negative", False),
        ("not the good", 0.5, "positive", False),
        ("", 0.0, "neutral", False),
        ("性能 非常 好", 0.75, "positive", False),
    ],
)
def test_sentiment(spark, text, score, label, mixed):
    found = one(spark, text, X.sentiment(X.tokens(F.col("text"))))
    assert (round(found.score, 6), found.label, found.mixed) == (score, label, mixed)


@pytest.mark.parametrize("text, language", [("the error is here", "en"), ("服务器的错误", "zh"), ("el servidor de la red", "es"), ("¿qué pasa?", "es"), ("は が を", "ja"), ("xyz", "en"), ("a", "en")])
def test_language(spark, text, language):
    assert one(spark, text, X.language(F.col("text"))) == language


def test_entities_carry_byte_offsets(spark):
    text = "é 10.0.0.1 and a@b.io, 10.0.0.2: connection refused\nfailed: disk"
    for column in (X.basic_entities, X.error_entities):
        for e in one(spark, text, column(F.col("text"))):
            assert e.value in text.encode()[e.start : e.end].decode()
    found = one(spark, text, X.basic_entities(F.col("text")))
    assert [(e.type, e.value, e.start) for e in found] == [("IP_ADDRESS", "10.0.0.1", 3), ("IP_ADDRESS", "10.0.0.2", 24), ("EMAIL", "a@b.io", 16)]
    assert [e.value for e in one(spark, "status 200 via http, 999 or 404", X.status_entities(F.col("text")))] == ["200", "404"]
    assert one(spark, "code 200", X.status_entities(F.col("text"))) == []
    times = "2024-02-30 10:00:00, 2024-02-28T10:00:00Z 13/40/2024 10:00:00 01/02/2024  10:00:00 Feb 30 10:00:00 Feb 29 10:00:00 1700000000 170000000012"
    assert [e.value for e in one(spark, times, X.timestamp_entities(F.col("text")))] == ["2024-02-28T10:00:00Z", "01/02/2024  10:00:00", "Feb 29 10:00:00", "1700000000"]


def test_keywords_phrases_category(spark):
    text = 'The "quick" fix: the login failed. Retry it now! Is it?\nThe end of it.'
    assert one(spark, text, X.keywords(F.col("text"))) == ["the", "quick", "fix", "login", "failed", "retry", "now", "end"]
    assert one(spark, text, X.keywords(F.col("text"), stop_words=True)) == ["quick", "fix", "login", "failed", "retry", "now", "end"]
    assert one(spark, text, X.phrases(F.col("text"))) == ['The "quick" fix: the login failed', "Retry it now", "The end of it."]
    assert [one(spark, t, X.category(F.col("text"))) for t in ("API down", "slow SQL", "bad token", "x", "request failed")] == ["http", "database", "security", "general", "error"]


def test_enrichment(spark):
    rows = [
        (0, "GET /api/users 200ms", "INFO", "user-service", '{"uid":"u1","user_id":"u2","org_id":"o"}', "json"),
        (1, "boom", "ERROR", "order-service", '{"exception":"NPE","http_status":503}', "json"),
        (2, "x", "INFO", "internal", '{"error_type":"E","http_status":404,"http_method":"PUT"}', "apache"),
    ]
    df = spark.createDataFrame(rows, "id long, message string, level string, service string, doc string, format string")
    out = S.enrich_logs(df.withColumn("fields", F.from_json("doc", DYNAMIC)), steps=[lambda d: d.withColumn("extra", F.lit(1))]).orderBy("id")
    a, b, c = out.withColumn("f", F.to_json("fields")).drop("fields").collect()
    assert (a.http_method, a.http_path, a.http_status, a.user_id, a.tenant_id, a.business_domain, a.is_critical, a.request_type) == ("GET", "/api/users", 200, "u1", "o", "identity", True, "read")
    assert (b.error_type, b.is_error, b.level_is_error, b.http_status, b.business_domain) == ("NPE", True, True, 0, "commerce")
    assert (c.error_type, c.is_error, c.level_is_error, c.http_status, c.http_method, c.api_type) == ("E", True, False, 404, "PUT", "internal")
    assert '"business_domain":"commerce"' in b.f and a.extra == 1


def test_transform_rules(spark):
    rules = TransformRules([TransformRule("a", "message", "x", "uppercase")])
    rules.add(TransformRule("a", "message", "x", "split", {"delimiter": "|"}))
    rules.apply([TransformRule("a", "message", "y", "regex", {"pattern": "(z)"}), TransformRule("b", "k", "n", "template", {"template": "<{{source}}>"})])
    rules.add(TransformRule("c", "message", "off", "direct", enabled=False))
    df = spark.createDataFrame([(" a | b||c ", '{"k":1.5}')], "message string, doc string").withColumn("fields", F.from_json("doc", DYNAMIC))
    assert transform_logs(df, rules).select(F.to_json("extracted").alias("e")).collect()[0].e == '{"x":["a","b","c"],"y":null,"n":"<1.5>"}'
    rules.remove("b")
    with pytest.raises(KeyError):
        rules.remove("b")
    with pytest.raises(ValueError):
        rules.add(TransformRule("", "m", "t", "direct"))
