"""Raw lines to parsed logs, in one narrow job.

A line is detected once, the parser is chosen once, and each output column is one
CASE over the chosen format, so a row runs only its own parser's patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweir.functions import timestamps as TS, words as W
from logweir.functions.fields import empty_fields
from logweir.functions.steps import compute_once
from logweir.functions.regex import find_all, group_labels, groups, java_pattern
from logweir.functions.values import variant_text
from logweir.functions.words import byte_prefix
from logweir.operators.detect import with_detection, with_json

# Field aliases, parser patterns and word lists.
ALIASES = {
    "timestamp": ("timestamp", "time", "ts"),
    "level": ("level", "lvl", "severity"),
    "message": ("message", "msg"),
    "service": ("service", "svc", "app"),
    "trace_id": ("trace_id", "traceID", "trace"),
    "span_id": ("span_id", "spanID", "span"),
}
PAIR_ALIASES = {
    "timestamp": ("timestamp", "time", "ts"),
    "level": ("level", "lvl"),
    "message": ("message", "msg"),
    "service": ("service", "svc"),
    "trace_id": ("trace_id", "traceid"),
    "span_id": ("span_id", "spanid"),
}
PAIR = r"(?<!\w)(\w++)[=:]\s*+(\S+)"
SYSLOG = r"^<(\d{1,3})>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*([^\n]*)\z"
ACCESS = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)\s+(\S+)"\s+(\d{3})\s+(\d+|-)'
ACCESS_AGENT = ACCESS + r'\s+"([^"]*)"\s+"([^"]*)"'
IP = r"(?<!\w)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w)"
URL = r"https?://[^\s<>\"{}|^\[\]]+"
EMAIL = r"[\w\-.]+@[\w\-.]+\.\w+"
ISO_TIME = r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
OTHER_TIMES = (r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}", r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}")
LEVEL = r"(?<!\w)(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|TRACE)(?!\w)"
HTTP_REQUEST = r"(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(\S+)\s*(?:HTTP/[\d.]+)?"
ERROR_DETAIL = r"(?:error|exception|failed|failure)[:\s]+([^\n]+)"
LOOSE_PAIR = r"(?<!\w)(\w++)[=:]\s*+([^\s,;]+)"
LOOSE_PAIR_SKIP = ("timestamp", "time", "level", "msg", "message")
PHRASE_STOP_WORDS = [
    "a", "an", "the", "and", "or", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "with", "by", "from",
]
SENTENCE_END = r"[.!?]+\s*"

STANDARD = ("timestamp", "level", "message", "service", "trace_id", "span_id", "fields")


def key_phrases(text: Column) -> Column:
    return W.content_words(text, PHRASE_STOP_WORDS)


def sentences(text: Column) -> Column:
    return W.sentences(text, SENTENCE_END)


def _v(col: Column) -> Column:
    return col.cast("variant")


def _optional_map(pairs: list[tuple[str, Column, Column | None]]) -> Column:
    """A map of the pairs whose condition holds (None: always)."""
    always = [x for name, value, cond in pairs if cond is None for x in (F.lit(name), _v(value))]
    out = [F.create_map(*always)] if always else [empty_fields()]
    for name, value, cond in pairs:
        if cond is not None:
            out.append(F.when(cond, F.create_map(F.lit(name), _v(value))).otherwise(empty_fields()))
    return F.map_concat(*out)


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    """First match, null when there is none; for groups that are never empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _first_or_empty(text: Column, pattern: str, group: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


# ---- one function per format: the pieces of a line in, a dict of columns out ----
#
# Pieces are what several columns of a format share: capture groups, pairs, match lists. The table
# jobs compute them once per line, as columns.


def _pairs(raw: Column, pattern: str) -> Column:
    return F.arrays_zip(find_all(raw, pattern, 1).alias("k"), find_all(raw, pattern, 2).alias("v"))


def pieces(raw: Column, fmt: Column) -> dict[str, Column]:
    is_ = lambda *names: fmt.isin(*names)
    free = is_("unstructured")
    nothing = F.array().cast("array<string>")
    return {
        "_groups": F.when(is_("syslog"), groups(raw, SYSLOG, 6))
        .when(is_("apache"), groups(raw, ACCESS, 9))
        .when(is_("nginx"), groups(raw, ACCESS_AGENT, 11)),
        "_pairs": F.when(is_("key_value"), _pairs(raw, PAIR)).when(free, _pairs(raw, LOOSE_PAIR)),
        "_json": F.when(is_("json"), F.struct(*[_pick(n).alias(n) for n in ALIASES])),
        "_ips": F.when(free, find_all(raw, IP)),
        # a cheap test first: most texts hold no such thing
        "_urls": F.when(free, F.when(raw.contains("://"), find_all(raw, URL)).otherwise(nothing)),
        "_emails": F.when(free, F.when(raw.contains("@"), find_all(raw, EMAIL)).otherwise(nothing)),
        "_phrases": F.when(free, key_phrases(raw)),
        "_level": F.when(free, _first(raw, LEVEL)),
        "_time": F.when(free, _first(raw, ISO_TIME)),
    }


def _pick(name: str) -> Column:
    return F.coalesce(*[F.try_element_at(F.col("_object"), F.lit(k)) for k in ALIASES[name]])


def json_columns(obj: Column) -> dict[str, Column]:
    known = [k for names in ALIASES.values() for k in names]
    text = {n: variant_text(F.col(f"_json.{n}")) for n in ("level", "message", "service", "trace_id", "span_id")}
    return {
        "timestamp": TS.parse_variant(F.col("_json.timestamp")),
        "level": F.coalesce(text["level"], F.lit("INFO")),
        **{n: F.coalesce(text[n], F.lit("")) for n in ("message", "service", "trace_id", "span_id")},
        "fields": F.map_filter(obj, lambda k, _: ~k.isin(known)),
    }


def pair_columns(pairs: Column) -> dict[str, Column]:
    known = [k for names in PAIR_ALIASES.values() for k in names]

    def last(name: str) -> Column:
        hits = F.filter(pairs, lambda p: p["k"].isin(*PAIR_ALIASES[name]))
        return F.btrim(F.get(hits, F.size(hits) - 1)["v"], F.lit('"'))

    rest = F.filter(pairs, lambda p: ~p["k"].isin(known))
    return {
        "timestamp": TS.parse_text(last("timestamp")),
        "level": F.coalesce(F.upper(last("level")), F.lit("INFO")),
        **{n: F.coalesce(last(n), F.lit("")) for n in ("message", "service", "trace_id", "span_id")},
        "fields": F.map_from_entries(F.transform(rest, lambda p: F.struct(p["k"], F.btrim(p["v"], F.lit('"')).cast("variant")))),
    }


def syslog_columns(g: Column, year: Column) -> dict[str, Column]:
    severity = F.get(g, F.lit(0)).try_cast("int") % 8
    level = F.when(severity <= 3, "ERROR").when(severity == 4, "WARN").when(severity == 7, "DEBUG").otherwise("INFO")
    pid = F.get(g, F.lit(4))
    return {
        "timestamp": TS.parse_syslog(F.get(g, F.lit(1)), year),
        "level": level,
        "message": F.get(g, F.lit(5)),
        "service": F.get(g, F.lit(3)),
        "trace_id": F.lit(""),
        "span_id": F.lit(""),
        "fields": _optional_map([("hostname", F.get(g, F.lit(2)), None), ("pid", pid, pid != "")]),
    }


def access_columns(g: Column, agent: bool) -> dict[str, Column]:
    part = lambda i: F.get(g, F.lit(i - 1))
    status = part(8).try_cast("int")
    pairs = [
        ("client_ip", part(1), None),
        ("http_method", part(5), None),
        ("http_path", part(6), None),
        ("http_protocol", part(7), None),
        ("http_status", status, None),
        ("response_size", part(9), part(9) != "-"),
    ]
    if agent:
        pairs += [("referer", part(10), part(10) != "-"), ("user_agent", part(11), part(11) != "-")]
    else:
        pairs += [("ident", part(2), part(2) != "-"), ("user", part(3), part(3) != "-")]
    return {
        "timestamp": TS.parse_access(part(4)),
        "level": F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO"),
        "message": F.concat_ws(" ", part(5), part(6), status.cast("string")),
        "service": F.lit(""),
        "trace_id": F.lit(""),
        "span_id": F.lit(""),
        "fields": _optional_map(pairs),
    }


def unstructured_columns(raw: Column, patterns: list[tuple[str, str, list[str]]] | None = None) -> dict[str, Column]:
    """``patterns``: extra (name, pattern, field names) in RE2 syntax, applied after the built-in ones."""
    ips, urls, level, phrases = F.col("_ips"), F.col("_urls"), F.col("_level"), F.col("_phrases")
    emails = F.col("_emails")
    last = lambda arr: F.get(arr, F.size(arr) - 1)
    when = TS.parse_text(F.col("_time"))
    found: list[tuple[str, Column]] = [
        ("extracted_ip", last(ips)),
        ("extracted_url", last(urls)),
        ("extracted_email", last(emails)),
        ("ip", F.get(ips, F.lit(0))),
        ("url", F.get(urls, F.lit(0))),
        ("http_method", _first(raw, HTTP_REQUEST, 1)),
        ("http_path", _first(raw, HTTP_REQUEST, 2)),
        ("error_detail", _first(raw, ERROR_DETAIL, 1)),
    ]
    level_out, when_out = F.coalesce(F.upper(level), F.lit("INFO")), when
    for _, pattern, names in patterns or []:
        java, count = java_pattern(pattern), len(group_labels(pattern))
        for i, name in enumerate(names[:count], 1):
            hit = _first_or_empty(raw, java, i)
            if name == "timestamp_str":
                when_out = F.when(hit.isNotNull(), TS.parse_text(hit)).otherwise(when_out)
            elif name == "level":
                level_out = F.coalesce(F.upper(hit), level_out)
            else:
                found.append(({"method": "http_method", "path": "http_path"}.get(name, name), hit))
    found += [
        ("timestamp_raw", F.coalesce(F.col("_time"), *[_first(raw, p) for p in OTHER_TIMES])),
        ("detected_level", level),
        ("detected_ips", F.when(F.size(ips) > 0, ips)),
        ("source_ip", F.when(F.size(ips) == 1, F.get(ips, F.lit(0)))),
        ("detected_urls", F.when(F.size(urls) > 0, urls)),
    ]
    # null values are the fields that were not found; of a repeated name the later one stands
    entries = F.filter(
        F.array(*[F.struct(F.lit(n).alias("key"), _v(c).alias("value")) for n, c in found]), lambda e: e["value"].isNotNull()
    )
    pairs = F.transform(
        F.filter(F.col("_pairs"), lambda p: ~p["k"].isin(*LOOSE_PAIR_SKIP)),
        lambda p: F.struct(F.concat(F.lit("kv_"), p["k"]).alias("key"), F.btrim(p["v"], F.lit('"')).cast("variant").alias("value")),
    )
    whole = F.when(F.octet_length(raw) > 200, F.concat(byte_prefix(raw, 200), F.lit("..."))).otherwise(raw)
    return {
        "timestamp": when_out,
        "level": level_out,
        "message": F.when(F.size(phrases) > 0, F.array_join(F.slice(phrases, 1, 5), " ")).otherwise(whole),
        "service": F.lit(""),
        "trace_id": F.lit(""),
        "span_id": F.lit(""),
        "fields": F.map_from_entries(F.concat(entries, pairs)),
    }


def regex_columns(raw: Column, pattern: str, names: list[str]) -> dict[str, Column]:
    """Groups by position to field names; timestamp, level, message and service are header columns."""
    java, count = java_pattern(pattern), len(group_labels(pattern))
    header = {"timestamp": F.lit(None).cast("timestamp"), "level": F.lit("INFO"), "message": F.lit(""), "service": F.lit("")}
    pairs = []
    for i, name in enumerate(names[:count], 1):
        value = F.regexp_extract(raw, java, i)
        if name == "timestamp":
            header[name] = TS.parse_text(value)
        elif name == "level":
            header[name] = F.upper(value)
        elif name in header:
            header[name] = value
        else:
            pairs.append((name, value, None))
    return {**header, "trace_id": F.lit(""), "span_id": F.lit(""), "fields": _optional_map(pairs) if pairs else empty_fields()}


# ---- table jobs ----


def _accepts(raw: Column, obj: Column) -> dict[str, Column]:
    return {
        "json": obj.isNotNull(),
        "key_value": raw.rlike(PAIR),
        "syslog": raw.rlike(SYSLOG),
        "apache": raw.rlike(ACCESS),
        "nginx": raw.rlike(ACCESS_AGENT),
        "unstructured": F.lit(True),
    }


def _ingest(ingest_ts: Column | None) -> Column:
    return F.current_timestamp() if ingest_ts is None else ingest_ts


def _columns(raw: Column, obj: Column, year: Column, patterns=None) -> dict[str, dict[str, Column]]:
    return {
        "json": json_columns(obj),
        "key_value": pair_columns(F.col("_pairs")),
        "syslog": syslog_columns(F.col("_groups"), year),
        "apache": access_columns(F.col("_groups"), agent=False),
        "nginx": access_columns(F.col("_groups"), agent=True),
        "unstructured": unstructured_columns(raw, patterns),
    }


def parse_logs(
    df: DataFrame,
    raw: str = "raw",
    *,
    ingest_ts: Column | None = None,
    year: Column | None = None,
    patterns: list[tuple[str, str, list[str]]] | None = None,
    detectors: list[tuple[str, Column]] | None = None,
) -> DataFrame:
    """Detect and parse every line; other columns pass through.

    ``ingest_ts`` stands in where a line has no readable timestamp and ``year`` completes syslog
    dates; pass columns of the table to make replays repeat.
    """
    carried = [c for c in df.columns if c != raw]
    line, obj = F.col(raw), F.col("_object")
    out = with_detection(df, raw, detectors)
    found = F.col("_found.format")
    accepts = _accepts(line, obj)
    # the detected parser, or else the first other one that takes the line
    chosen = F.when(found.isin("json", "apache", "nginx", "unstructured"), found)
    for name in ("key_value", "syslog"):
        chosen = chosen.when((found == name) & accepts[name], F.lit(name))
    for name in ("json", "key_value", "syslog", "apache", "nginx"):
        chosen = chosen.when(accepts[name], F.lit(name))
    out = compute_once(out, {"format": chosen.otherwise(F.lit("unstructured"))})
    out = out.withColumns(pieces(line, F.col("format")))
    return _project(out, carried, line, obj, ingest_ts, year, patterns)


def _project(out, carried, line, obj, ingest_ts, year, patterns=None) -> DataFrame:
    ingest = _ingest(ingest_ts)
    by_format = _columns(line, obj, F.year(ingest) if year is None else year, patterns)
    columns = []
    for name in STANDARD:
        value = F.when(F.lit(False), F.lit(None))
        for fmt, cols in by_format.items():
            value = value.when(F.col("format") == fmt, cols[name])
        if name == "timestamp":
            value = F.coalesce(value, ingest.cast("timestamp"))
        columns.append(value.alias(name))
    return out.select(*carried, *columns, line.alias("raw"), "format")


def parse_as(df: DataFrame, format: str, raw: str = "raw", *, ingest_ts=None, year=None, patterns=None) -> DataFrame:
    """Parse with one given format. ``parsed`` is false where the line does not fit it; such rows carry nulls."""
    line, obj = F.col(raw), F.col("_object")
    ingest = _ingest(ingest_ts)
    out = with_json(df, raw) if format == "json" else df.withColumn("_object", empty_fields())
    out = out.withColumns(pieces(line, F.lit(format)))
    accepts = _accepts(line, obj)
    if format not in accepts:
        raise ValueError(f"unsupported format: {format}")
    cols = _columns(line, obj, F.year(ingest) if year is None else year, patterns)[format]
    return _forced(out, [c for c in df.columns if c != raw], line, accepts[format], cols, ingest, format)


def parse_regex(df: DataFrame, pattern: str, names: list[str], raw: str = "raw", *, ingest_ts=None) -> DataFrame:
    """Parse with a pattern of one's own; ``parsed`` as in ``parse_as``."""
    line = F.col(raw)
    hit = line.rlike(java_pattern(pattern))
    return _forced(df, [c for c in df.columns if c != raw], line, hit, regex_columns(line, pattern, names), _ingest(ingest_ts), "regex")


def _forced(out, carried, line, accepts, cols, ingest, format) -> DataFrame:
    cols = {**cols, "timestamp": F.coalesce(cols["timestamp"], ingest.cast("timestamp"))}
    out = out.withColumn("parsed", F.coalesce(accepts, F.lit(False)))
    return out.select(
        *carried,
        *[F.when(F.col("parsed"), cols[n]).alias(n) for n in STANDARD],
        line.alias("raw"),
        F.lit(format).alias("format"),
        "parsed",
    )


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected raw lines) of a forced parse."""
    return parsed.filter("parsed").drop("parsed"), parsed.filter("not parsed").select("raw", "format")


def parser_stats(parsed: DataFrame) -> DataFrame:
    ok = F.col("parsed") if "parsed" in parsed.columns else F.lit(True)
    return parsed.groupBy("format").agg(
        F.count(F.lit(1)).alias("total_parsed"), F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("failure_count")
    )
