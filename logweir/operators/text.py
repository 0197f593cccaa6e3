"""Text analysis columns: entities, keywords, phrases, category, sentiment, language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweir.functions import timestamps as TS, words as W
from logweir.functions.regex import find_all
from logweir.functions.steps import compute_once

# Entity patterns.
IP = r"(?<!\w)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w)"
URL = r"https?://[^\s<>\"{}|^\[\]]+"
EMAIL = r"[\w\-.]+@[\w\-.]+\.\w+"
TIMES = {
    "iso8601": r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    "us_date": r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}",
    "syslog": r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    "unix": r"\d{10,13}",
}
ERRORS = {
    "ERROR_ERROR_MESSAGE": r"(?i)(error|exception|failed|failure|fatal|critical)[:\s]+([^\n]+)",
    "ERROR_PANIC": r"(?i)(panic|segfault|segmentation fault)[:\s]*([^\n]*)",
    "ERROR_TIMEOUT": r"(?i)(timeout|timed out)[:\s]*([^\n]*)",
    "ERROR_CONNECTION_ERROR": r"(?i)(connection refused|connection reset|connection lost)",
}
STATUS = r"(?<!\w)[1-5][0-9]{2}(?!\w)"
# Words around a status code, user id patterns, stop words, sentence ends.
HTTP_WORDS = "http|get|post|put|delete|request|response|url|path"
USERS = (
    r"(?:user[_-]?id|uid|user)[=:]\s*([a-zA-Z0-9_-]+)",
    r"(?:user[_-]?name|username|login)[=:]\s*([a-zA-Z0-9_-]+)",
)
KEYWORD_STOP_WORDS = [
    "a", "an", "the", "and", "or", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "with", "by", "from",
    "this", "that", "these", "those", "我", "的", "了", "是", "在", "就", "都",
]
SENTENCE_BREAK = r"[.!?][ \n]"
# Category words, first match wins.
CATEGORIES = {
    "error": "error|exception|failed|failure",
    "http": "http|request|response|api",
    "database": "database|sql|query",
    "security": "auth|login|token|permission",
}
# Sentiment lexicon.
POSITIVE = {
    "good": 0.5, "great": 0.8, "excellent": 1.0, "amazing": 0.9,
    "success": 0.7, "successful": 0.8, "passed": 0.6, "complete": 0.5,
    "fast": 0.4, "quick": 0.4, "efficient": 0.5, "helpful": 0.5,
    "positive": 0.5, "happy": 0.7, "satisfied": 0.6, "perfect": 1.0,
    "好": 0.5, "很好": 0.7, "优秀": 0.9, "成功": 0.7, "完美": 1.0,
    "快": 0.4, "快速": 0.5, "高效": 0.6, "满意": 0.6,
}
NEGATIVE = {
    "bad": -0.5, "terrible": -0.9, "horrible": -1.0, "awful": -0.8,
    "error": -0.6, "failed": -0.7, "failure": -0.8, "exception": -0.5,
    "slow": -0.4, "crash": -0.8, "broken": -0.7, "wrong": -0.5,
    "negative": -0.5, "sad": -0.6, "angry": -0.7, "disappointed": -0.7,
    "错误": -0.6, "失败": -0.7, "异常": -0.5,
    "慢": -0.4, "崩溃": -0.8, "损坏": -0.7, "糟糕": -0.8,
}
INTENSIFIERS = {
    "very": 1.5, "extremely": 2.0, "really": 1.5, "incredibly": 2.0,
    "so": 1.3, "highly": 1.5, "completely": 1.8, "totally": 1.8,
    "非常": 1.5, "极其": 2.0, "真的": 1.5, "十分": 1.5,
}
NEGATORS = ["not", "no", "never", "neither", "nobody", "nothing", "nowhere", "不", "没", "没有", "从未"]
# Language profiles, in the order ties are settled.
SPECIAL_CHARACTERS = {"zh": "的了是在就都而及与着", "es": "ñ¿¡"}
COMMON_WORDS = {
    "en": {
        "the": 1.0, "a": 0.9, "an": 0.8, "is": 0.8, "are": 0.7, "was": 0.7, "were": 0.6, "be": 0.6, "been": 0.5, "being": 0.5,
        "have": 0.7, "has": 0.7, "had": 0.6, "do": 0.6, "does": 0.5, "did": 0.5, "will": 0.6, "would": 0.5, "could": 0.5,
        "should": 0.5, "error": 0.4, "info": 0.3, "warning": 0.3, "debug": 0.3,
    },
    "zh": {
        "的": 1.0, "了": 0.9, "是": 0.8, "在": 0.7, "就": 0.6, "都": 0.5, "而": 0.5, "及": 0.4, "与": 0.5, "着": 0.5,
        "错误": 0.4, "信息": 0.3, "警告": 0.3, "调试": 0.3,
    },
    "es": {"el": 1.0, "la": 1.0, "de": 0.9, "que": 0.8, "y": 0.8, "a": 0.7, "en": 0.7, "un": 0.6, "una": 0.6, "es": 0.6},
    "ja": {"は": 1.0, "が": 0.9, "を": 0.8, "に": 0.8, "で": 0.7, "と": 0.6, "も": 0.6, "の": 0.9, "ます": 0.5, "です": 0.5},
}
LANGUAGE_BOUND = 0.3

ENTITY_LIST = "array<struct<type:string,value:string,confidence:double,start:bigint,end:bigint>>"


def entities(text: Column, pattern: str, kind: str, confidence: float, group: int = 0) -> Column:
    """All matches with the byte offsets of the whole match.

    The pieces between matches and the matches themselves add up to the offsets.
    """
    between, found, values = F.split(text, pattern, -1), find_all(text, pattern), find_all(text, pattern, group)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(ENTITY_LIST).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        begin = acc["at"] + F.octet_length(F.get(between, i))
        end = begin + F.octet_length(F.get(found, i))
        value = W.trim_space(F.get(values, i)) if group else F.get(values, i)
        one = F.struct(F.lit(kind), value, F.lit(confidence), begin, end)
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["out"], F.array(one).cast(ENTITY_LIST)).alias("out"))

    indexes = F.sequence(F.lit(0), F.size(found) - 1)
    return F.when(text.rlike(pattern), F.aggregate(indexes, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(ENTITY_LIST))


def basic_entities(text: Column) -> Column:
    return F.concat(
        entities(text, IP, "IP_ADDRESS", 0.95), entities(text, URL, "URL", 0.95), entities(text, EMAIL, "EMAIL", 0.9)
    )


def _valid_time(value: Column, shape: str) -> Column:
    tidy = F.regexp_replace(value, " +", " ")
    if shape == "iso8601":
        return TS.parse_text(value).isNotNull()
    if shape == "us_date":
        return F.try_to_timestamp(tidy, F.lit("MM/dd/yyyy HH:mm:ss")).isNotNull()
    if shape == "syslog":
        return TS.parse_syslog(value, F.lit(2000)).isNotNull() & ~value.rlike(r"[\t\n\r\f]")
    return F.octet_length(value).isin(10, 13)


def timestamp_entities(text: Column) -> Column:
    def valid(shape: str):
        return lambda e: _valid_time(e["value"], shape)

    return F.concat(*[F.filter(entities(text, pattern, "TIMESTAMP", 0.85), valid(shape)) for shape, pattern in TIMES.items()])


def error_entities(text: Column) -> Column:
    """The value is the keyword, the offsets are those of the whole match."""
    return F.concat(*[entities(text, pattern, kind, 0.9, group=1) for kind, pattern in ERRORS.items()])


def status_entities(text: Column) -> Column:
    """Three-digit codes with an HTTP word within 50 bytes."""
    raw = F.encode(text, "UTF-8")

    def near_http(e: Column) -> Column:
        begin = F.greatest(e["start"] - 50, F.lit(0).cast("bigint"))
        around = F.decode(F.substring(raw, begin.cast("int") + 1, (e["start"] + 50 - begin).cast("int")), "ISO-8859-1")
        return F.lower(around).rlike(HTTP_WORDS)

    return F.filter(entities(text, STATUS, "HTTP_STATUS", 0.85), near_http)


def user_entities(text: Column) -> Column:
    return F.concat(*[entities(text, p, "USER_ID", 0.8, group=1) for p in USERS])


def keywords(text: Column, stop_words: bool = False) -> Column:
    return F.slice(F.array_distinct(W.content_words(text, KEYWORD_STOP_WORDS if stop_words else None)), 1, 10)


def phrases(text: Column) -> Column:
    parts = W.sentences(text, SENTENCE_BREAK)
    return F.slice(F.filter(parts, lambda s: (F.octet_length(s) > 10) & (F.octet_length(s) < 200)), 1, 5)


def category(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(F.lit(False), "")
    for name, pattern in CATEGORIES.items():
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("general")


def tokens(text: Column) -> Column:
    cleaned = F.transform(W.words(F.lower(text)), lambda w: W.strip_punctuation(w, W.TOKEN_PUNCTUATION))
    return F.filter(cleaned, lambda w: w != "")


def _lookup(word: Column, table: dict[str, float]) -> Column:
    # one IN test per distinct weight, a hash set each
    weights: dict[float, list[str]] = {}
    for name, weight in table.items():
        weights.setdefault(weight, []).append(name)
    out = F.when(F.lit(False), 0.0)
    for weight, names in weights.items():
        out = out.when(word.isin(names), weight)
    return out


def sentiment(words: Column) -> Column:
    """``struct<score, label, mixed>`` of a token list. Words outside the lexicon end a negation or intensifier."""
    lexicon = POSITIVE | NEGATIVE
    start = F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("negated"), F.lit(1.0).alias("factor"))

    def state(score: Column, negated: Column, factor: Column) -> Column:
        return F.struct(score.alias("score"), negated.alias("negated"), factor.alias("factor"))

    def step(acc: Column, word: Column) -> Column:
        weight = _lookup(word, lexicon) * acc["factor"]
        weight = F.when(acc["negated"], -weight * 0.5).otherwise(weight)
        return (
            F.when(word.isin(NEGATORS), state(acc["score"], F.lit(True), acc["factor"]))
            .when(word.isin(list(INTENSIFIERS)), state(acc["score"], acc["negated"], _lookup(word, INTENSIFIERS)))
            .when(word.isin(list(lexicon)), state(acc["score"] + weight, F.lit(False), F.lit(1.0)))
            .otherwise(state(acc["score"], F.lit(False), F.lit(1.0)))
        )

    has = lambda table: F.arrays_overlap(words, F.array(*[F.lit(w) for w in table]))
    total = F.when(has(lexicon), F.aggregate(words, start, step, lambda acc: acc["score"])).otherwise(0.0)
    score = F.greatest(F.least(total, F.lit(1.0)), F.lit(-1.0))
    return F.struct(
        score.alias("score"),
        F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral").alias("label"),
        (has(POSITIVE) & has(NEGATIVE)).alias("mixed"),
    )


def language(text: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, characters in SPECIAL_CHARACTERS.items():
        out = out.when(text.rlike(f"[{characters}]"), name)
    known = sorted({w for table in COMMON_WORDS.values() for w in table})
    hits = F.filter(W.words(F.lower(text)), lambda w: w.isin(known))

    def mean(found: Column, table: dict[str, float]) -> Column:
        mine = F.filter(found, lambda w: w.isin(list(table)))
        total = F.aggregate(mine, F.lit(0.0), lambda acc, w: acc + _lookup(w, table))
        return F.when(F.size(mine) > 0, total / F.size(mine)).otherwise(0.0)

    def means(found: Column) -> Column:
        ranked = enumerate(COMMON_WORDS.items())
        return F.array_max(
            F.array(*[F.struct(mean(found, t).alias("mean"), F.lit(-i).alias("rank"), F.lit(n).alias("name")) for i, (n, t) in ranked])
        )

    # a one-element list binds the hits once
    best = F.get(F.transform(F.array(hits), means), F.lit(0))
    return F.coalesce(out, F.when(best["mean"] > LANGUAGE_BOUND, best["name"]), F.lit("en"))


# Columns by name; a caller's own feature columns join them.
EXTRACTORS = {"basic": basic_entities, "timestamp": timestamp_entities, "error": error_entities}
OPTIONAL_EXTRACTORS = {"http_status": status_entities, "user_id": user_entities}


def analyze_text(
    df: DataFrame,
    column: str = "message",
    *,
    extractors: dict | None = None,
    features: dict[str, Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Adds entities, keywords, key_phrases, category, sentiment, language and metadata.

    ``features`` are extra named columns, gathered in ``metadata``. Rows outside ``where`` get nulls.
    """
    text = F.col(column) if where is None else F.when(where, F.col(column))
    out = df.withColumn("_text", text)
    text = F.col("_text")
    out = out.withColumn("_tokens", tokens(text))
    found = F.concat(*[f(text) for f in (EXTRACTORS if extractors is None else extractors).values()])
    meta = F.create_map(*[x for k, c in features.items() for x in (F.lit(k), c.cast("string"))]) if features else None
    columns = {
        "entities": found,
        "keywords": keywords(text),
        "key_phrases": phrases(text),
        "category": F.when(text.isNotNull(), category(text)),
        "sentiment": F.when(text.isNotNull(), sentiment(F.col("_tokens"))),
        "language": F.when(text.isNotNull(), language(text)),
        **({"metadata": meta} if meta is not None else {}),
    }
    return compute_once(out, columns).drop("_text", "_tokens")
