"""The free-text score of lines."""

import pytest
from pyspark.sql import functions as F

from logweir.functions import words as W
from logweir.operators import detect as D

LINES = [
    None, "", " ", "a b c d e", "a b c d", "  a b c d  e ", "　a　b　c　d　e ", "\u0085a b c d e", "a\x0bb\x0bc\x0bd\x0be", "a\x1cb c d", "été à la plage où êtes vous",
    "你好 世界 你 好 吗", "😀 😀 😀 😀 😀 ab", "𐐀𐐁 𐐂 c d e f", "{}", " {a} ", "[x y z] ", "　<a b c d e f>　", "{a b c d e f] and more words here", "{\na b c d e f\n}", "<only an opening and words",
    "12 34 56 78 90", "ERROR in 2024-01-01 12:00:00", "ſucceſs ıNFO straße fünf sechs", "x" * 50_000, "ab " * 20_000, "[a] 10.0.0.1 12:00:00 word word", "�́ é a b c",
]


def listed(raw):
    """The score by lists of matches."""
    trimmed = W.trim_space(raw)
    shaped = trimmed.rlike(r"(?s)^(?:\{.*\}|\[.*\]|<.*>)\z") | trimmed.isin("{}", "[]")
    ratio = F.regexp_count(raw, F.lit(f"[\\p{{L}}{W.SPACE}]")) / F.octet_length(raw)
    marks = sum((raw.rlike(p).cast("int") for p in D.PLAIN_MARKS), F.lit(0)) / F.lit(3.0)
    parts = [((F.octet_length(raw) > 0) & (ratio >= 0.7), 0.3), (W.word_count(raw) >= 5, 0.2), (marks <= 0.3, 0.2), (~raw.rlike(D.TIMESTAMP_MARKS), 0.15), (~F.upper(raw).rlike(D.LEVEL_MARKS), 0.15)]
    score = F.round(sum((F.when(c, w).otherwise(0.0) for c, w in parts), F.lit(0.0)), 2)
    return F.when(~shaped & (score >= 0.5), score)


def test_same_score_as_by_lists(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "id int, raw string")
    rows = df.select("raw", D.unstructured_score(F.col("raw")).alias("got"), listed(F.col("raw")).alias("want")).collect()
    assert [(r.raw, r.got) for r in rows] == [(r.raw, r.want) for r in rows]
    assert len({r.got for r in rows}) > 3


@pytest.mark.parametrize("word", ["regexp_count", "regexp_extract_all"])
def test_no_list_of_matches(spark, word):
    """A list of matches of single characters takes many times the text's memory."""
    df = spark.createDataFrame([(x,) for x in LINES], "raw string")
    assert word not in df.select(D.unstructured_score(F.col("raw")))._jdf.queryExecution().toString()
