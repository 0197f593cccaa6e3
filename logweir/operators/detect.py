"""Format detection of raw lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logweir.functions import words as W
from logweir.functions.steps import compute_once

FORMATS = ("json", "key_value", "syslog", "apache", "nginx", "unstructured")

# Line shapes and score weights of the detectors.
KEY_VALUE = r"(?<![\w-])[\w-]++[=:]\s*+\S+"
SYSLOG = (
    r"^<\d{1,3}>\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\w+",
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+",
)
ACCESS_COMMON = r'^\S+\s+\S+\s+\S+\s+\[[^\]]+\]\s+"[A-Z]+\s+\S+\s+\S+"\s+\d{3}\s+\d+\z'
ACCESS_COMBINED = r'^\S+\s+\S+\s+\S+\s+\[[^\]]+\]\s+"[A-Z]+\s+\S+\s+\S+"\s+\d{3}\s+\d+\s+"[^"]*"\s+"[^"]*"'
COMMON_KEYS = ("timestamp", "level", "message", "service", "trace_id")
PLAIN_MARKS = (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", r"\d{2}:\d{2}:\d{2}", r"\[.*?\]")
TIMESTAMP_MARKS = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}:\d{2}:\d{2}"
FIVE_WORDS = rf"\A[{W.SPACE}]*+(?:[^{W.SPACE}]++[{W.SPACE}]++){{4}}[^{W.SPACE}]"
LEVEL_MARKS = "DEBUG|INFO|WARN|ERROR|FATAL|TRACE|CRITICAL|SUCCESS"


def with_json(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``_object``: the line as ``map<string,variant>`` when it is exactly one JSON object, else null.

    The parser stops after the first value; wrapping the line shows whether anything followed it.
    """
    line = F.col(raw)
    wrapped = F.try_parse_json(F.concat(F.lit('{"line":'), line, F.lit(',"end":0}')))
    bare = F.btrim(line, F.lit(" \t\r\n"))
    parts = F.when(bare.startswith("{") & bare.endswith("}"), F.try_variant_get(wrapped, "$", "map<string,variant>"))
    out = df.withColumn("_parts", parts)
    whole = (F.size("_parts") == 2) & F.map_contains_key("_parts", "end")
    value = F.try_variant_get(F.try_element_at("_parts", F.lit("line")), "$", "map<string,variant>")
    return out.withColumn("_object", F.when(whole, value)).drop("_parts")


def _result(name: str, confidence) -> Column:
    confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(F.lit(name).alias("format"), confidence.cast("double").alias("confidence"))


def key_value_confidence(pairs: Column, word_count: Column) -> Column:
    ratio = F.try_divide(pairs.cast("double"), word_count.cast("double"))
    return F.when((pairs >= 2) & (ratio >= 0.5), F.lit(0.7) + ratio * F.lit(0.2))


def _choose(raw: Column, obj: Column, pair_confidence: Column, custom: list[tuple[str, Column]] | None) -> Column:
    hits = sum((F.map_contains_key(obj, k).cast("int") for k in COMMON_KEYS), F.lit(0))
    json_confidence = F.when(hits.between(1, 2), 0.9).otherwise(1.0)
    syslog = raw.rlike(SYSLOG[0]) | raw.rlike(SYSLOG[1]) | raw.rlike(SYSLOG[2])
    chosen = (
        F.when(obj.isNotNull(), _result("json", json_confidence))
        .when(pair_confidence > 0.8, _result("key_value", pair_confidence))
        .when(syslog, _result("syslog", 0.9))
        .when(raw.rlike(ACCESS_COMMON), _result("apache", 0.95))
        .when(raw.rlike(ACCESS_COMBINED), _result("nginx", 0.95))
    )
    for name, confidence in custom or []:
        chosen = chosen.when(confidence > 0.8, _result(name, confidence))
    return chosen.otherwise(_result("unstructured", 0.5))


def with_detection(df: DataFrame, raw: str, custom: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Adds ``_object`` (the line as a JSON object) and ``_found``, ``struct<format, confidence>``.

    The first detector above 0.8 wins, else the line is unstructured at 0.5. ``custom`` appends
    (format, confidence) detectors. Shared counts are columns of their own, so each is taken once.
    """
    line = F.col(raw)
    out = with_json(df, raw)
    out = out.withColumn("_pair_count", F.when(F.col("_object").isNull(), F.regexp_count(line, F.lit(KEY_VALUE))))
    out = out.withColumn("_word_count", F.when(F.col("_pair_count") >= 2, W.word_count(line)))
    out = out.withColumn("_pair_confidence", key_value_confidence(F.col("_pair_count"), F.col("_word_count")))
    return compute_once(out, {"_found": _choose(line, F.col("_object"), F.col("_pair_confidence"), custom)})


def unstructured_score(raw: Column) -> Column:
    """How much a line looks like free text, 0 to 1; null for JSON, list or markup shapes and below 0.5."""
    # only what opens with a bracket is looked at as a whole
    opens = raw.rlike(f"\\A[{W.SPACE}]*+[{{\\[<]")
    trimmed = W.trim_space(raw)
    shaped = opens & (trimmed.rlike(r"(?s)^(?:\{.*\}|\[.*\]|<.*>)\z") | trimmed.isin("{}", "[]"))
    # letters and spaces are counted by what is left without the rest: a list of matches would hold every character
    plain = F.regexp_replace(raw, r"[^a-zA-Z\s]++", "")
    wide = F.regexp_replace(raw, f"[^\\p{{L}}{W.SPACE}]++", "")
    text_ratio = F.char_length(F.when(W.is_ascii(raw), plain).otherwise(wide)) / F.octet_length(raw)
    marks = sum((raw.rlike(p).cast("int") for p in PLAIN_MARKS), F.lit(0)) / F.lit(3.0)
    nonempty = F.octet_length(raw) > 0
    score = (
        F.when(nonempty & (text_ratio >= 0.7), 0.3).otherwise(0.0)
        + F.when(raw.rlike(FIVE_WORDS), 0.2).otherwise(0.0)
        + F.when(marks <= 0.3, 0.2).otherwise(0.0)
        + F.when(~raw.rlike(TIMESTAMP_MARKS), 0.15).otherwise(0.0)
        + F.when(~F.upper(raw).rlike(LEVEL_MARKS), 0.15).otherwise(0.0)
    )
    # the sum is in steps of 0.05; rounding keeps the 0.5 bound free of float error
    # as a list, so that the sum is worked out once
    return F.when(~shaped, F.get(F.filter(F.array(F.round(score, 2)), lambda s: s >= 0.5), F.lit(0)))


def detect_formats(df: DataFrame, raw: str = "raw", custom: list[tuple[str, Column]] | None = None) -> DataFrame:
    return with_detection(df, raw, custom).select(*df.columns, "_found.format", "_found.confidence")


def evaluate(df: DataFrame, *, expected: str = "expected_format", predicted: str = "format") -> tuple[DataFrame, DataFrame]:
    """Detector quality over labelled lines: (per-format scores with overall accuracy, confusion counts)."""
    pairs = df.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    confusion = pairs.select(F.concat_ws("->", "expected", "predicted").alias("pair"), "n")
    # from here on the data is at most formats x formats rows
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("expected").alias("format"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("guessed")),
                F.struct(F.col("predicted").alias("format"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("guessed")),
            )
        ),
        F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0).alias("right"),
    )
    by_format = sides.groupBy("format").agg(
        F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"), (F.sum("right") / 2).alias("hits")
    )
    overall = pairs.agg((F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    precision = F.when(F.col("guessed") > 0, F.col("hits") / F.col("guessed")).otherwise(0.0)
    recall = F.when(F.col("actual") > 0, F.col("hits") / F.col("actual")).otherwise(0.0)
    scores = (
        by_format.filter(F.col("format").isin(*FORMATS))
        .withColumns({"precision": precision, "recall": recall})
        .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
        .crossJoin(F.broadcast(overall))  # one row
        .select("format", "precision", "recall", "f1", "accuracy")
    )
    return scores, confusion


def thresholds(df: DataFrame, *, expected: str = "expected_format", predicted: str = "format", confidence: str = "confidence") -> DataFrame:
    """Best confidence threshold per format, 0.30 to 0.90 in steps of 0.05; the lowest of equals, 0.5 if none scores.

    Hits below the threshold count neither as false positives nor as misses.
    """
    # distinct (expected, predicted, confidence in steps) combinations carry all that matters
    step = F.floor(F.round(F.col(confidence) * 20, 6)).cast("int")
    pairs = df.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted"), step.alias("step")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = pairs.select(
        F.explode(F.array(*[F.lit(f) for f in FORMATS])).alias("format"), "expected", "predicted", "step", "n"
    ).withColumn("threshold", F.explode(F.sequence(F.lit(6), F.lit(18))))
    said, meant = F.col("predicted") == F.col("format"), F.col("expected") == F.col("format")
    sure = F.col("step") >= F.col("threshold")
    scored = grid.groupBy("format", "threshold").agg(
        F.sum(F.when(said & meant & sure, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(said & ~meant & sure, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~said & meant, F.col("n")).otherwise(0)).alias("fn"),
    )
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    best = scored.withColumn("f1", f1).groupBy("format").agg(
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("at"), F.max("f1").alias("f1")
    )
    return best.select("format", F.when(F.col("f1") > 0, F.col("at") / 20).otherwise(0.5).alias("threshold"), "f1")
