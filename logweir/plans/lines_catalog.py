"""Queries over raw lines and texts: detection, parsing, analysis, transforms, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logweir.functions import timestamps as TS
from logweir.operators import detect as D, parse as P, semantic as S, text as X
from logweir.operators.transform import TransformRule, transform_logs
from logweir.plans import oracle as O
from logweir.plans.registry import json_field, query, time_text
from logweir.session import scratch
from logweir.sources import readers, views

NOW = "2024-01-31 00:00:00"
NOW_TEXT = "2024-01-31 00:00:00.000000"

# ---- detection ----

# The line patterns and thresholds in SQL.
_FORMAT = r"""case when json_valid(raw) and starts_with(raw, '{') then 'json'
 when len(regexp_extract_all(raw, '[\w_-]+[=:]\s*[\S]+')) >= 2 and len(regexp_extract_all(raw, '[\w_-]+[=:]\s*[\S]+')) / len(regexp_extract_all(raw, '\S+')) > 0.5 then 'key_value'
 when regexp_matches(raw, '^<\d{1,3}>\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}') or regexp_matches(raw, '^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\w+') or regexp_matches(raw, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+') then 'syslog'
 when regexp_matches(raw, '^\S+\s+\S+\s+\S+\s+\[[^\]]+\]\s+"[A-Z]+\s+\S+\s+\S+"\s+\d{3}\s+\d+$') then 'apache'
 when regexp_matches(raw, '^\S+\s+\S+\s+\S+\s+\[[^\]]+\]\s+"[A-Z]+\s+\S+\s+\S+"\s+\d{3}\s+\d+\s+"[^"]*"\s+"[^"]*"') then 'nginx'
 else 'unstructured' end"""
_RATIO = r"len(regexp_extract_all(raw, '[\w_-]+[=:]\s*[\S]+')) / len(regexp_extract_all(raw, '\S+'))"
DETECTED = f"detected as (select *, {_FORMAT} format from raw_lines)"


@query(
    "training_samples",
    O.lines("""select raw log, case id % 6 when 0 then 'json' when 1 then 'key_value' when 2 then 'syslog' when 3 then 'apache' when 4 then 'nginx' else 'unstructured' end expected_format, 'logs' source
        from raw_lines"""),
)
def training_samples(spark, folder):
    """Labelled lines written to the shared folder and read back."""
    path = scratch(spark, "samples")
    formats = F.array(*map(F.lit, ("json", "key_value", "syslog", "apache", "nginx", "unstructured")))
    lines = views.raw_lines(spark, folder)
    readers.write_samples(lines.select(F.col("raw").alias("log"), F.get(formats, (F.col("id") % 6).cast("int")).alias("expected_format"), F.lit("logs").alias("source")), path)
    return readers.read_samples(spark, path)


@query(
    "detect_format",
    O.lines(f"select id, format, round(case format when 'json' then 1.0 when 'key_value' then 0.7 + 0.2 * {_RATIO} when 'syslog' then 0.9 when 'unstructured' then 0.5 else 0.95 end, 6) confidence from detected", DETECTED),
)
def detect_format(spark, folder):
    return D.detect_formats(views.raw_lines(spark, folder)).select("id", "format", F.round("confidence", 6).alias("confidence"))


def _texts(spark, folder) -> DataFrame:
    return views.table(spark, folder, "documents").select("doc_id", "text")


@query(
    "unstructured_score",
    r"""select doc_id, case when score >= 0.5 and not shaped then score end score from (select doc_id,
      regexp_matches(trim(text, E' \t\n\r\f'), '(?s)^(\{.*\}|\[.*\]|<.*>)$') shaped,
      round(case when len(regexp_extract_all(text, '[\p{L}\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')) / strlen(text) >= 0.7 then 0.3 else 0 end
      + case when len(regexp_extract_all(text, '\S+')) >= 5 then 0.2 else 0 end
      + case when cast(regexp_matches(text, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}') as int) + cast(regexp_matches(text, '\d{2}:\d{2}:\d{2}') as int) + cast(regexp_matches(text, '\[.*?\]') as int) = 0 then 0.2 else 0 end
      + case when not regexp_matches(text, '\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}:\d{2}:\d{2}') then 0.15 else 0 end
      + case when not regexp_matches(upper(text), 'DEBUG|INFO|WARN|ERROR|FATAL|TRACE|CRITICAL|SUCCESS') then 0.15 else 0 end, 2)::double score from documents)""",
)
def unstructured_score(spark, folder):
    return _texts(spark, folder).select("doc_id", D.unstructured_score(F.col("text")).alias("score"))


# ---- parsing ----


def _parsed(spark, folder) -> DataFrame:
    return P.parse_logs(views.raw_lines(spark, folder), ingest_ts=F.lit(NOW).cast("timestamp"), year=F.lit(2024))


_SECOND = """strftime(date_trunc('second', "timestamp"), '%Y-%m-%d %H:%M:%S.%f')"""
_HEAD = f"""select l.id, d.format,
 case l.id % 6 when 5 then '{NOW_TEXT}' else {_SECOND} end ts,
 case l.id % 6 when 0 then level when 1 then level when 2 then case when l.id % 8 <= 3 then 'ERROR' when l.id % 8 = 4 then 'WARN' when l.id % 8 = 7 then 'DEBUG' else 'INFO' end
  when 3 then case l.id % 4 when 1 then 'WARN' when 2 then 'ERROR' else 'INFO' end when 4 then case l.id % 3 when 0 then 'INFO' when 1 then 'ERROR' else 'WARN' end else 'INFO' end level,
 case l.id % 6 when 0 then message when 1 then "function" when 2 then concat("function", ' done')
  when 3 then concat('GET /api/v1/items/', cast(l.id % 50 as varchar), ' ', case l.id % 4 when 0 then '200' when 1 then '404' when 2 then '503' else '301' end)
  when 4 then concat('POST /api/v1/orders ', case l.id % 3 when 0 then '201' when 1 then '500' else '400' end)
  else concat('connection 192.168.', cast(l.id % 250 as varchar), '.4 slow ', lower("function"), ' failed') end message,
 case when l.id % 6 < 3 then service else '' end service, case when l.id % 6 < 2 then trace_id else '' end trace_id"""

# parsed lines with their text
PARSED_LINES = f"{_HEAD}, raw from logs l join detected d on l.id = d.id"


@query(
    "parse_logs",
    O.lines(
        _HEAD
        + r""", case when l.id % 6 = 0 then concat('{"user_id":"', user_id, '"}') when l.id % 6 = 1 then concat('{"line":"', cast(line_number as varchar), '"}')
        when l.id % 6 = 2 then concat('{"hostname":"host', cast(l.id % 9 as varchar), '","pid":"', cast(1000 + l.id % 500 as varchar), '"}') else '' end fields,
        case when l.id % 6 in (3, 4) then regexp_extract(raw, '^\S+') else '' end client_ip from logs l join detected d on l.id = d.id""",
        DETECTED,
    ),
)
def parse_logs(spark, folder):
    return _parsed(spark, folder).select(
        "id", "format", time_text("timestamp").alias("ts"), "level", "message", "service", "trace_id",
        F.when(F.col("format").isin("json", "key_value", "syslog"), F.to_json("fields")).otherwise("").alias("fields"),
        F.coalesce(json_field("client_ip"), F.lit("")).alias("client_ip"),
    )


def _forced(spark, folder, format: str) -> DataFrame:
    return P.parse_as(views.raw_lines(spark, folder), format, ingest_ts=F.lit(NOW).cast("timestamp"), year=F.lit(2024))


@query("parse_forced", O.lines(r"""select id, regexp_matches(raw, '^<(\d{1,3})>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$') parsed, case when not parsed then raw end rejected from raw_lines"""))
def parse_forced(spark, folder):
    out = _forced(spark, folder, "syslog")
    accepted, rejects = P.split_rejects(out)
    return accepted.select("id", F.lit(True).alias("parsed"), F.lit(None).cast("string").alias("rejected")).unionByName(
        out.filter("not parsed").select("id", "parsed", F.col("raw").alias("rejected"))
    )


def _json_sql(path: str) -> str:
    return f"case when parsed then json_extract_string(raw, '{path}') end"


@query(
    "parse_json",
    O.lines(
        f"""select id, parsed, {_json_sql('$.level')} level, {_json_sql('$.message')} message, {_json_sql('$.service')} service, {_json_sql('$.trace_id')} trace_id,
        case when parsed then strftime(cast(json_extract_string(raw, '$.timestamp') as timestamp), {O.TIME}) end ts, {_json_sql('$.user_id')} user_id
        from (select *, json_valid(raw) parsed from raw_lines)"""
    ),
)
def parse_json(spark, folder):
    return _forced(spark, folder, "json").select(
        "id", "parsed", "level", "message", "service", "trace_id", time_text("timestamp").alias("ts"), json_field("user_id").alias("user_id")
    )


def _last_pair(*names: str) -> str:
    wanted = ", ".join(f"'{n}'" for n in names)
    return f"trim(list_filter(pairs, lambda p: p.k in ({wanted}))[-1].v, '\"')"


@query(
    "parse_kv",
    O.lines(
        f"""select id, len(pairs) > 0 parsed, case when len(pairs) > 0 then coalesce(upper({_last_pair('level', 'lvl')}), 'INFO') end level,
        case when len(pairs) > 0 then coalesce({_last_pair('message', 'msg')}, '') end message, case when len(pairs) > 0 then coalesce({_last_pair('service', 'svc')}, '') end service,
        case when len(pairs) > 0 then coalesce({_last_pair('trace_id', 'traceid')}, '') end trace_id, {_last_pair('line')} line,
        case when len(pairs) > 0 then (select count(distinct p.k) from (select unnest(pairs) p) where p.k not in
        ('timestamp', 'time', 'ts', 'level', 'lvl', 'message', 'msg', 'service', 'svc', 'trace_id', 'traceid', 'span_id', 'spanid')) end others
        from (select id, list_transform(list_zip(regexp_extract_all(raw, p, 1), regexp_extract_all(raw, p, 2)), lambda x: struct_pack(k := x[1], v := x[2])) pairs
          from raw_lines, (select '(\\w+)[=:]\\s*([^\\s]+|"[^"]*")' p))"""
    ),
)
def parse_kv(spark, folder):
    out = _forced(spark, folder, "key_value")
    return out.select(
        "id", "parsed", "level", "message", "service", "trace_id", json_field("line").alias("line"),
        F.when(F.col("parsed"), F.size("fields")).cast("bigint").alias("others"),
    )


def _group(pattern: str, i: int, cast: str = "") -> str:
    return f"case when parsed then {cast}regexp_extract(raw, '{pattern}', {i}) end" if not cast else f"case when parsed then cast(regexp_extract(raw, '{pattern}', {i}) as {cast}) end"


_SYSLOG = r"^<(\d{1,3})>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$"
_ACCESS = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)\s+(\S+)"\s+(\d{3})\s+(\d+|-)'
_ACCESS_AGENT = _ACCESS + r'\s+"([^"]*)"\s+"([^"]*)"'
_AGENT_ONLY = r'^\S+\s+\S+\s+\S+\s+\[[^\]]+\]\s+"[A-Z]+\s+\S+\s+\S+"\s+\d{3}\s+(?:\d+|-)\s+"([^"]*)"\s+"([^"]*)"'


@query(
    "parse_syslog",
    O.lines(
        f"""select id, parsed, case when not parsed then null when p % 8 <= 3 then 'ERROR' when p % 8 = 4 then 'WARN' when p % 8 = 7 then 'DEBUG' else 'INFO' end level,
        {_group(_SYSLOG, 6)} message, {_group(_SYSLOG, 4)} service, {_group(_SYSLOG, 3)} hostname, {_group(_SYSLOG, 5)} pid,
        case when parsed then strftime(strptime(concat('2024 ', regexp_extract(raw, '{_SYSLOG}', 2)), '%Y %b %d %H:%M:%S'), {O.TIME}) end ts
        from (select *, regexp_matches(raw, '{_SYSLOG}') parsed, case when regexp_matches(raw, '{_SYSLOG}') then cast(regexp_extract(raw, '{_SYSLOG}', 1) as int) end p from raw_lines)"""
    ),
)
def parse_syslog(spark, folder):
    return _forced(spark, folder, "syslog").select(
        "id", "parsed", "level", "message", "service", json_field("hostname").alias("hostname"), json_field("pid").alias("pid"), time_text("timestamp").alias("ts")
    )


def _access_sql(pattern: str, extra: str) -> str:
    status = f"cast(regexp_extract(raw, '{pattern}', 8) as int)"
    return O.lines(
        f"""select id, parsed, case when not parsed then null when {status} >= 500 then 'ERROR' when {status} >= 400 then 'WARN' else 'INFO' end level,
        case when parsed then concat(regexp_extract(raw, '{pattern}', 5), ' ', regexp_extract(raw, '{pattern}', 6), ' ', regexp_extract(raw, '{pattern}', 8)) end message,
        {_group(pattern, 1)} client_ip, {_group(pattern, 7)} protocol, {_group(pattern, 8, 'bigint')} status, {_group(pattern, 9)} size, {extra},
        case when parsed then strftime(strptime(regexp_extract(raw, '{pattern}', 4), '%d/%b/%Y:%H:%M:%S +0000'), {O.TIME}) end ts
        from (select *, regexp_matches(raw, '{pattern}') parsed from raw_lines)"""
    )


def _access_columns(df: DataFrame, *more) -> DataFrame:
    return df.select(
        "id", "parsed", "level", "message", json_field("client_ip").alias("client_ip"), json_field("http_protocol").alias("protocol"),
        json_field("http_status").cast("bigint").alias("status"), json_field("response_size").alias("size"), time_text("timestamp").alias("ts"), *more,
    )


@query("parse_apache", _access_sql(_ACCESS, f"case when parsed then nullif(regexp_extract(raw, '{_ACCESS}', 3), '-') end \"user\""))
def parse_apache(spark, folder):
    return _access_columns(_forced(spark, folder, "apache"), json_field("user").alias("user"))


@query("parse_nginx", _access_sql(_ACCESS_AGENT, f"{_group(_AGENT_ONLY, 1)} referer, {_group(_AGENT_ONLY, 2)} agent"))
def parse_nginx(spark, folder):
    return _access_columns(_forced(spark, folder, "nginx"), json_field("referer").alias("referer"), json_field("user_agent").alias("agent"))


_PHRASE_STOP = ", ".join(f"'{w}'" for w in P.PHRASE_STOP_WORDS)
_CUT = r"""[.,!?;:()\[\]{{}}"''`{more}]"""


def _words_sql(text: str, more: str = "") -> str:
    cut = _CUT.format(more=more)
    space = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    split = f"list_filter(string_split_regex(lower({text}), '[{space}]+'), lambda w: w <> '')"
    return f"list_transform({split}, lambda w: regexp_replace(w, '^{cut}+|{cut}+$', '', 'g'))"


def _phrases_sql(text: str) -> str:
    return f"list_filter({_words_sql(text)}, lambda w: strlen(w) > 2 and w not in ({_PHRASE_STOP}))"


def _one(pattern: str, group: int = 0) -> str:
    return f"case when regexp_matches(raw, '{pattern}') then regexp_extract(raw, '{pattern}', {group}) end"


_RE2_IP, _RE2_URL, _RE2_EMAIL = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r'https?://[^\s<>"{}|^\[\]]+', r"[\w\-.]+@[\w\-.]+\.\w+"


@query(
    "parse_unstructured",
    O.lines(
        rf"""select id, coalesce({_one(r'\b(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|TRACE)\b')}, 'INFO') level,
        array_to_string(list_slice({_phrases_sql('raw')}, 1, 5), ' ') message, regexp_extract_all(raw, '{_RE2_IP}')[-1] extracted_ip,
        regexp_extract_all(raw, '{_RE2_URL}')[-1] extracted_url, regexp_extract_all(raw, '{_RE2_EMAIL}')[-1] extracted_email,
        {_one(r'(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(\S+)\s*(?:HTTP/[\d.]+)?', 2)} http_path, {_one(r'(?:error|exception|failed|failure)[:\s]+([^\n]+)', 1)} error_detail,
        coalesce({_one(r'\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?')}, {_one(r'\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}')}, {_one(r'\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}')}) timestamp_raw,
        case when len(regexp_extract_all(raw, '{_RE2_IP}')) = 1 then regexp_extract(raw, '{_RE2_IP}') end source_ip, regexp_extract_all(raw, '(\w+)[=:]\s*([^\s,;]+|"[^"]*")', 1)[-1] last_key from raw_lines"""
    ),
)
def parse_unstructured(spark, folder):
    out = _forced(spark, folder, "unstructured")
    names = ("extracted_ip", "extracted_url", "extracted_email", "http_path", "error_detail", "timestamp_raw", "source_ip")
    keys = P.find_all(F.col("raw"), P.LOOSE_PAIR, 1)
    return out.select("id", "level", "message", *[json_field(n).alias(n) for n in names], F.get(keys, F.size(keys) - 1).alias("last_key"))


@query(
    "parse_regex",
    O.logs(
        r"""select id, regexp_matches(message, '^(upstream|slow) (\w+) (.+)$') parsed, case when parsed then upper(regexp_extract(message, '^(upstream|slow) (\w+) (.+)$', 2)) end level,
        case when parsed then regexp_extract(message, '^(upstream|slow) (\w+) (.+)$', 3) end message, case when parsed then regexp_extract(message, '^(upstream|slow) (\w+) (.+)$', 1) end kind from logs"""
    ),
)
def parse_regex(spark, folder):
    logs = views.logs(spark, folder).select("id", F.col("message").alias("raw"))
    out = P.parse_regex(logs, r"^(upstream|slow) (?P<what>\w+) (.+)$", ["kind", "level", "message"], ingest_ts=F.lit(NOW).cast("timestamp"))
    return out.select("id", "parsed", "level", "message", json_field("kind").alias("kind"))


@query(
    "parse_custom_pattern",
    O.lines(r"""select id, case when regexp_matches(raw, 'status\.example\.com/(\d+)') then regexp_extract(raw, 'status\.example\.com/(\d+)', 1) end ticket,
    case when regexp_matches(raw, '\[(\d+)\]: (\w+)') then upper(regexp_extract(raw, '\[(\d+)\]: (\w+)', 2)) when regexp_matches(raw, '\b(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|TRACE)\b') then regexp_extract(raw, '\b(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|TRACE)\b') else 'INFO' end level from raw_lines"""),
)
def parse_custom_pattern(spark, folder):
    patterns = [("ticket", r"status\.example\.com/(\d+)", ["ticket"]), ("unit", r"\[(\d+)\]: (\w+)", ["unit_pid", "level"])]
    out = P.parse_as(views.raw_lines(spark, folder), "unstructured", ingest_ts=F.lit(NOW).cast("timestamp"), patterns=patterns)
    return out.select("id", json_field("ticket").alias("ticket"), "level")


@query(
    "parse_timestamp",
    O.logs(
        f"""select id, case id % 5 when 3 then null when 4 then null else strftime(case id % 5 when 2 then "timestamp" else date_trunc('second', "timestamp") end, {O.TIME}) end ts from logs"""
    ),
)
def parse_timestamp(spark, folder):
    shapes = F.expr(
        """case id % 5 when 0 then date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'") when 1 then date_format(timestamp, 'yyyy-MM-dd HH:mm:ss')
        when 2 then date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'") when 3 then date_format(timestamp, 'yyyy-MM-dd HH:mm') else '2024-02-30 00:00:00' end"""
    )
    return views.logs(spark, folder).select("id", time_text(TS.parse_text(shapes)).alias("ts"))


@query("key_phrases", f"select conv_id, turn, array_to_string({_phrases_sql('text')}, ' ') phrases, cast(len(list_filter(list_transform(string_split_regex(text, '[.!?]+\\s*'), lambda s: trim(s, E' \\t\\n\\r\\f')), lambda s: s <> '')) as bigint) sentences from conversations")
def key_phrases(spark, folder):
    rows = views.table(spark, folder, "conversations")
    return rows.select(
        "conv_id", "turn", F.array_join(P.key_phrases(F.col("text")), " ").alias("phrases"), F.size(P.sentences(F.col("text"))).cast("bigint").alias("sentences")
    )


# ---- text analysis ----


def _entity_sql(table: str, key: str, text: str, kind: str, pattern: str, group: int = 0, flags: str = "") -> str:
    value = f"trim(regexp_extract_all({text}, '{pattern}', {group})[i], E' \\t\\n\\r\\f')" if group else f"regexp_extract_all({text}, '{pattern}')[i]"
    return f"""select {key}, '{kind}' kind, {value} as value,
     cast(strlen(array_to_string(list_slice(parts, 1, i), '')) + strlen(array_to_string(list_slice(found, 1, i - 1), '')) as bigint) "start", cast("start" + strlen(found[i]) as bigint) "end"
     from (select {key}, {text}, regexp_extract_all({text}, '{pattern}') found, string_split_regex({text}, '{pattern}') parts, unnest(generate_series(1, len(found))) i from {table})"""


def _entity_rows(df: DataFrame, key: str, entities) -> DataFrame:
    return df.select(key, F.inline(entities)).select(key, F.col("type").alias("kind"), "value", "start", "end")


@query(
    "entities_basic",
    " union all ".join(_entity_sql("documents", "doc_id", "text", k, p) for k, p in (("IP_ADDRESS", _RE2_IP), ("URL", _RE2_URL), ("EMAIL", _RE2_EMAIL))),
)
def entities_basic(spark, folder):
    return _entity_rows(_texts(spark, folder), "doc_id", X.basic_entities(F.col("text")))


_ISO = r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"


@query(
    "entities_timestamp",
    O.lines(
        "select id, kind, value, \"start\", \"end\" from ("
        + _entity_sql("raw_lines", "id", "raw", "TIMESTAMP", _ISO)
        + r") where regexp_matches(value, '^\S+T\S+(Z|[+-]\d{2}:\d{2})$|^\S+ \S+$') and not regexp_matches(value, ' \S*(Z|[+-]\d{2}:?\d{2})$') union all "
        + _entity_sql("raw_lines", "id", "raw", "TIMESTAMP", r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}")
        + " union all select * from ("
        + _entity_sql("raw_lines", "id", "raw", "TIMESTAMP", r"\d{10,13}")
        + ") where strlen(value) in (10, 13)"
    ),
)
def entities_timestamp(spark, folder):
    return _entity_rows(views.raw_lines(spark, folder), "id", X.timestamp_entities(F.col("raw")))


@query(
    "entities_error",
    O.lines(" union all ".join(_entity_sql("raw_lines", "id", "raw", kind, pattern, 1) for kind, pattern in X.ERRORS.items())),
)
def entities_error(spark, folder):
    return _entity_rows(views.raw_lines(spark, folder), "id", X.error_entities(F.col("raw")))


@query(
    "entities_http_status",
    O.lines(
        "select id, kind, value, \"start\", \"end\" from (select e.*, r.raw from ("
        + _entity_sql("raw_lines", "id", "raw", "HTTP_STATUS", r"\b[1-5][0-9]{2}\b")
        + ") e join raw_lines r on e.id = r.id) where regexp_matches(lower(substr(raw, greatest(\"start\" - 50, 0) + 1, \"start\" + 50 - greatest(\"start\" - 50, 0))), 'http|get|post|put|delete|request|response|url|path')"
    ),
)
def entities_http_status(spark, folder):
    return _entity_rows(views.raw_lines(spark, folder), "id", X.status_entities(F.col("raw")))


@query("entities_user", O.logs(" union all ".join(_entity_sql("logs", "id", "message", "USER_ID", p, 1) for p in X.USERS)))
def entities_user(spark, folder):
    return _entity_rows(views.logs(spark, folder), "id", X.user_entities(F.col("message")))


_DISTINCT = "list_filter(w, lambda x, i: list_position(w, x) = i)"


@query(
    "keywords",
    f"""select doc_id, array_to_string(list_slice({_DISTINCT}, 1, 10), ' ') keywords from (
    select doc_id, list_filter({_words_sql('text')}, lambda x: strlen(x) > 2) w from documents)""",
)
def keywords(spark, folder):
    return _texts(spark, folder).select("doc_id", F.array_join(X.keywords(F.col("text")), " ").alias("keywords"))


@query(
    "phrases",
    r"""select doc_id, array_to_string(list_slice(list_filter(list_transform(string_split_regex(text, '[.!?][ \n]'), lambda s: trim(s, E' \t\n\r\f')),
    lambda s: strlen(s) > 10 and strlen(s) < 200), 1, 5), '|') phrases from documents""",
)
def phrases(spark, folder):
    return _texts(spark, folder).select("doc_id", F.array_join(X.phrases(F.col("text")), "|").alias("phrases"))


_CATEGORY = " ".join(f"when regexp_matches(lower(text), '{p}') then '{n}'" for n, p in X.CATEGORIES.items())


@query("category", f"select doc_id, case {_CATEGORY} else 'general' end category from documents")
def category(spark, folder):
    return _texts(spark, folder).select("doc_id", X.category(F.col("text")).alias("category"))


def _weights(table: dict[str, float], word: str) -> str:
    return "case " + word + " " + " ".join(f"when '{w}' then {x}" for w, x in table.items()) + " end"


def _sentiment_sql() -> str:
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    lexicon = X.POSITIVE | X.NEGATIVE
    step = f"""case when w in ({quoted(X.NEGATORS)}) then struct_pack(score := a.score, neg := true, factor := a.factor, w := '')
      when w in ({quoted(X.INTENSIFIERS)}) then struct_pack(score := a.score, neg := a.neg, factor := cast({_weights(X.INTENSIFIERS, 'w')} as double), w := '')
      when w in ({quoted(lexicon)}) then struct_pack(score := a.score + (case when a.neg then -0.5 else 1.0 end) * a.factor * {_weights(lexicon, 'w')}, neg := false, factor := 1.0::double, w := '')
      else struct_pack(score := a.score, neg := false, factor := 1.0::double, w := '') end"""
    return f"""select conv_id, turn, label, score from (select *, case when score > 0.1 then 'positive' when score < -0.1 then 'negative' else 'neutral' end label from (
      select conv_id, turn, round(greatest(least(list_reduce(list_prepend(struct_pack(score := 0.0::double, neg := false, factor := 1.0::double, w := ''),
        list_transform(tokens, lambda t: struct_pack(score := 0.0::double, neg := false, factor := 1.0::double, w := t))), lambda a, b: {step.replace(' w in', ' b.w in').replace('case w ', 'case b.w ')}).score, 1.0), -1.0), 6) score
      from (select conv_id, turn, list_filter({_words_sql('text', '-')}, lambda t: t <> '') tokens from conversations)))"""


@query("sentiment", _sentiment_sql())
def sentiment(spark, folder):
    rows = views.table(spark, folder, "conversations").withColumn("_tokens", X.tokens(F.col("text")))
    found = rows.withColumn("s", X.sentiment(F.col("_tokens")))
    return found.select("conv_id", "turn", F.col("s.label").alias("label"), F.round("s.score", 6).alias("score"))


def _language_sql() -> str:
    words = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"
    parts = []
    for name, table in X.COMMON_WORDS.items():
        names = ", ".join(f"'{w}'" for w in table)
        hits = f"list_filter(w, lambda x: x in ({names}))"
        parts.append(f"coalesce(list_avg(list_transform({hits}, lambda x: cast({_weights(table, 'x')} as double))), 0) as {name}_mean")
    special = " ".join(f"when regexp_matches(text, '[{c}]') then '{n}'" for n, c in X.SPECIAL_CHARACTERS.items())
    best = "greatest(en_mean, zh_mean, es_mean, ja_mean)"
    return f"""select doc_id, case {special} when {best} <= 0.3 then 'en' when en_mean = {best} then 'en' when zh_mean = {best} then 'zh' when es_mean = {best} then 'es' else 'ja' end "language"
    from (select doc_id, text, {', '.join(parts)} from (select doc_id, text, {words} w from documents))"""


@query("language", _language_sql())
def language(spark, folder):
    return _texts(spark, folder).select("doc_id", X.language(F.col("text")).alias("language"))


@query("analyze_text", O.lines("select format, count(*) n, count(*) filter (format = 'unstructured') analysed from detected group by format", DETECTED))
def analyze_text(spark, folder):
    out = X.analyze_text(_parsed(spark, folder), where=F.col("format") == "unstructured", features={"bytes": F.octet_length("message")})
    whole = F.col("entities").isNotNull() & (F.size("keywords") > 0) & F.col("sentiment").isNotNull() & F.col("language").isNotNull()
    return out.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("analysed"))


# ---- transforms ----


def _tx(spark, folder, *rules: tuple[str, str, dict], source: str = "message", analysed: bool = False) -> DataFrame:
    logs = views.logs(spark, folder)
    made = [TransformRule(f"r{i}", src, target, extractor, config) for i, (extractor, src, target, config) in enumerate(rules)]
    return transform_logs(logs, made)


def _extracted(key: str):
    return json_field(key, "extracted").alias(key)


@query(
    "tx_regex",
    O.logs(
        r"""select id, case when regexp_matches(message, '^(GET|POST) (\S+) (\d{3})') then concat('{"code":"', regexp_extract(message, '^(GET|POST) (\S+) (\d{3})', 3), '","verb":"', regexp_extract(message, '^(GET|POST) (\S+) (\d{3})', 1), '"}') end request,
        case when regexp_matches(message, '(\d+)ms') then regexp_extract(message, '(\d+)ms', 1) end took, case when regexp_matches(message, 'slow \w+') then regexp_extract(message, 'slow \w+') end whole from logs"""
    ),
)
def tx_regex(spark, folder):
    rules = (
        ("regex", "message", "request", {"pattern": r"^(?P<verb>GET|POST) (\S+) (?P<code>\d{3})"}),
        ("regex", "message", "took", {"pattern": r"(\d+)ms"}),
        ("regex", "message", "whole", {"pattern": r"slow \w+"}),
        ("regex", "nowhere", "skipped", {"pattern": r"x"}),
        ("unknown", "message", "skipped", {}),
    )
    return _tx(spark, folder, *rules).select("id", _extracted("request"), _extracted("took"), _extracted("whole"))


@query("tx_template", O.logs("select id, concat('[', service, '] seen') label from logs"))
def tx_template(spark, folder):
    return _tx(spark, folder, ("template", "service", "label", {"template": "[{{source}}] seen"})).select("id", _extracted("label"))


@query("tx_direct", O.logs("select id, cast(k as varchar) copy from logs"))
def tx_direct(spark, folder):
    return _tx(spark, folder, ("direct", "k", "copy", {})).select("id", _extracted("copy"))


@query("tx_lower", O.logs("select id, lower(level) low from logs"))
def tx_lower(spark, folder):
    return _tx(spark, folder, ("lowercase", "level", "low", {})).select("id", _extracted("low"))


@query("tx_upper", O.logs("select id, upper(service) up from logs"))
def tx_upper(spark, folder):
    return _tx(spark, folder, ("uppercase", "service", "up", {})).select("id", _extracted("up"))


@query("tx_split", O.logs("""select id, concat('["', array_to_string(list_filter(list_transform(string_split(message, '='), lambda p: trim(p)), lambda p: p <> ''), '","'), '"]') parts from logs"""))
def tx_split(spark, folder):
    return _tx(spark, folder, ("split", "message", "parts", {"delimiter": "="})).select("id", _extracted("parts"))


@query("tx_jsonpath", O.logs("select id, cast(k as varchar) k from logs"))
def tx_jsonpath(spark, folder):
    logs = views.logs(spark, folder).withColumnRenamed("fields_json", "raw")
    return transform_logs(logs, [TransformRule("r", "raw", "k", "jsonpath", {"path": "$.k"})]).select("id", _extracted("k"))


@query(
    "tx_entities",
    O.lines(
        rf"""select id, regexp_extract_all(raw, '{_RE2_IP}')[1] entity_IP_ADDRESS_0, case when regexp_matches(raw, '{_RE2_IP}') then regexp_extract_all(raw, '{_RE2_URL}')[1] end entity_URL_1,
        regexp_extract_all(raw, '{_RE2_URL}')[1] first_url from raw_lines"""
    ),
)
def tx_entities(spark, folder):
    lines = views.raw_lines(spark, folder).withColumn("message", F.col("raw"))
    analysed = X.analyze_text(lines, extractors={"basic": X.basic_entities})
    out = transform_logs(analysed, [TransformRule("r", "URL", "first_url", "direct", {})])
    return out.select("id", _extracted("entity_IP_ADDRESS_0"), F.when(_extracted("entity_IP_ADDRESS_0").isNotNull(), _extracted("entity_URL_1")).alias("entity_URL_1"), _extracted("first_url"))


# ---- enrichment ----


def _enriched(spark, folder) -> DataFrame:
    return S.enrich_logs(views.logs(spark, folder).withColumnRenamed("user_id", "who"))


_REQUEST = r"^\s*(\S+)\s+(\S+)\s+([+-]?\d+)"


@query(
    "sem_http",
    O.logs(
        rf"""select id, regexp_extract(message, '{_REQUEST}', 1) http_method, regexp_extract(message, '{_REQUEST}', 2) http_path,
        case when regexp_matches(message, '{_REQUEST}') then cast(regexp_extract(message, '{_REQUEST}', 3) as bigint) else 0 end http_status,
        case when regexp_matches(message, '{_REQUEST}') then 'http_request' end category from logs"""
    ),
)
def sem_http(spark, folder):
    return _enriched(spark, folder).select("id", "http_method", "http_path", F.col("http_status").cast("bigint").alias("http_status"), json_field("category").alias("category"))


def _with_fields(spark, folder, sql: str) -> DataFrame:
    """Logs whose dynamic fields come from a JSON text expression."""
    logs = views.logs(spark, folder).withColumnRenamed("user_id", "who")
    return logs.withColumn("fields", F.from_json(F.expr(sql), "map<string,variant>"))


@query("sem_user", O.logs("select id, case when id % 3 = 0 then concat('uid', cast(k as varchar)) when id % 3 = 1 then user_id else '' end user_id from logs"))
def sem_user(spark, folder):
    doc = """concat('{"user_id":"', who, '"', case when id % 3 = 0 then concat(',"uid":"uid', get_json_object(fields_json, '$.k'), '"}') when id % 3 = 1 then '}' else ',"uid":7}' end)"""
    return S.enrich_logs(_with_fields(spark, folder, doc)).select("id", "user_id")


@query(
    "sem_error",
    O.logs("""select id, level = 'ERROR' level_is_error, case when id % 4 = 0 then 'Timeout' when id % 4 = 1 and level = 'ERROR' then 'IOError' else '' end error_type,
    id % 4 = 0 or (id % 4 = 1 and level = 'ERROR') is_error from logs"""),
)
def sem_error(spark, folder):
    doc = """case id % 4 when 0 then '{"error_type":"Timeout"}' when 1 then '{"exception":"IOError"}' else '{}' end"""
    return S.enrich_logs(_with_fields(spark, folder, doc)).select("id", "level_is_error", "error_type", "is_error")


_DOMAIN = "case when service in ('order-service', 'payment-service') then 'commerce' when service in ('user-service', 'auth-service') then 'identity' when service = 'content-service' then 'content' else 'general' end"


@query("sem_domain", O.logs(f"select id, {_DOMAIN} business_domain, concat('dim-', coalesce(cast(n_regionkey as varchar), '')) dim from logs left join nation on n_nationkey = id % 25"))
def sem_domain(spark, folder):
    logs = _enriched(spark, folder).withColumnRenamed("business_domain", "built_in").withColumnsRenamed({"service": "svc"})
    logs = logs.withColumn("service", (F.col("id") % 25).cast("string"))
    nation = views.table(spark, folder, "nation")
    dim = nation.select(F.col("n_nationkey").cast("string").alias("service"), F.concat(F.lit("dim-"), "n_regionkey").alias("business_domain"))
    return S.with_domain(logs, dim).select("id", F.col("built_in").alias("business_domain"), F.col("business_domain").alias("dim"))


@query("sem_tenant", O.logs("select id, case when id % 2 = 0 then concat('org-', cast(k as varchar)) else user_id end tenant_id from logs"))
def sem_tenant(spark, folder):
    doc = """concat('{"tenant_id":"', who, '"', case when id % 2 = 0 then concat(',"org_id":"org-', get_json_object(fields_json, '$.k'), '"}') else '}' end)"""
    return S.enrich_logs(_with_fields(spark, folder, doc)).select("id", "tenant_id")


@query(
    "sem_message",
    O.lines(
        rf"""select id, case when regexp_matches(raw, '{_RE2_IP}') then regexp_extract(raw, '{_RE2_IP}') end detected_ip, case when regexp_matches(raw, 'https?://[^\s]+') then regexp_extract(raw, 'https?://[^\s]+') end detected_url,
        case when regexp_matches(raw, '(?i)(error|exception|failed|failure)[:\s]+([^\n]+)') then trim(regexp_extract(raw, '(?i)(error|exception|failed|failure)[:\s]+([^\n]+)', 2)) end error_detail from raw_lines"""
    ),
)
def sem_message(spark, folder):
    columns = S.message_columns(F.col("raw"))
    return views.raw_lines(spark, folder).select("id", *[c.alias(n) for n, c in columns.items()])


@query(
    "sem_attributes",
    O.logs(
        """select id, case when contains(service, 'api') or contains(service, 'gateway') then 'gateway' when contains(service, 'internal') then 'internal' end api_type,
        case when contains(lower(message), 'get ') then 'read' when contains(lower(message), 'post ') or contains(lower(message), 'put ') or contains(lower(message), 'create') then 'write' end request_type,
        case when regexp_matches(service, 'payment|order|auth|user') then true end is_critical, case when regexp_matches(lower(message), 'password|token|secret|key|credential|privacy') then true end is_sensitive from logs"""
    ),
)
def sem_attributes(spark, folder):
    return _enriched(spark, folder).select("id", "api_type", "request_type", "is_critical", "is_sensitive")


@query(
    "sem_document",
    O.lines(
        r"""select l.id, case when l.id % 6 in (0, 3, 4) and regexp_matches(m, '^\s*(\S+)\s+(\S+)\s+([+-]?\d+)') then cast(regexp_extract(m, '^\s*(\S+)\s+(\S+)\s+([+-]?\d+)', 3) as bigint) else 0 end http_status,
        case when l.id % 6 = 0 then l.user_id else '' end user_id, false is_error from logs l join (select id, case id % 6 when 0 then message
        when 3 then concat('GET /api/v1/items/', cast(id % 50 as varchar), ' ', case id % 4 when 0 then '200' when 1 then '404' when 2 then '503' else '301' end)
        when 4 then concat('POST /api/v1/orders ', case id % 3 when 0 then '201' when 1 then '500' else '400' end) else '' end m from logs) x on l.id = x.id"""
    ),
)
def sem_document(spark, folder):
    return S.enrich_logs(_parsed(spark, folder)).select("id", F.col("http_status").cast("bigint").alias("http_status"), "user_id", "is_error")


@query("level_from_status", O.lines(r"""select id, case when s >= 500 then 'ERROR' when s >= 400 then 'WARN' else 'INFO' end level from (select id, cast(nullif(regexp_extract(raw, '" (\d{3}) ', 1), '') as int) s from raw_lines)"""))
def level_from_status(spark, folder):
    status = F.regexp_extract("raw", r'" (\d{3}) ', 1).try_cast("int")
    return views.raw_lines(spark, folder).select("id", S.level_from_status(status).alias("level"))


# ---- quality of detection and parsing ----

_LABELS = "case when id % 50 = 0 then 'syslog' else case id % 6 when 0 then 'json' when 1 then 'key_value' when 2 then 'syslog' when 3 then 'apache' when 4 then 'nginx' else 'unstructured' end end"
_LABELLED = f"labelled as (select id, format, {_LABELS} expected, case format when 'json' then 1.0 when 'key_value' then 0.7 + 0.2 * {_RATIO} when 'syslog' then 0.9 when 'unstructured' then 0.5 else 0.95 end confidence from detected)"


def _labelled(spark, folder) -> DataFrame:
    return D.detect_formats(views.raw_lines(spark, folder)).withColumn("expected_format", F.expr(_LABELS))


@query(
    "detector_eval",
    O.lines(
        """select format, round(p, 9) "precision", round(r, 9) recall, round(2 * p * r / (p + r), 9) f1, round((select count(*) filter (expected = format) / count(*) from labelled), 9) accuracy from (
        select f.format, (select count(*) from labelled l where l.format = f.format and expected = f.format) / (select count(*) from labelled l where l.format = f.format) p,
        (select count(*) from labelled l where l.format = f.format and expected = f.format) / (select count(*) from labelled l where expected = f.format) r from (select distinct format from detected) f)""",
        DETECTED, _LABELLED,
    ),
)
def detector_eval(spark, folder):
    scores, _ = D.evaluate(_labelled(spark, folder))
    return scores.select("format", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("detector_confusion", O.lines("select concat(expected, '->', format) pair, count(*) n from labelled group by 1", DETECTED, _LABELLED))
def detector_confusion(spark, folder):
    return D.evaluate(_labelled(spark, folder))[1]


@query(
    "detector_thresholds",
    O.lines(
        """, scored as (select f.format, t, count(*) filter (l.format = f.format and expected = f.format and confidence >= t / 20.0 - 1e-9) tp, count(*) filter (l.format = f.format and expected <> f.format and confidence >= t / 20.0 - 1e-9) fp,
        count(*) filter (l.format <> f.format and expected = f.format) fn from labelled l, (select distinct format from detected) f, generate_series(6, 18) g(t) group by f.format, t),
        f as (select format, t, case when tp = 0 then 0 else round(2.0 * tp / (2 * tp + fp + fn), 9) end f1 from scored)
        select format, arg_max(t, (f1, -t)) / 20.0 threshold, max(f1) f1 from f group by format""",
        DETECTED, _LABELLED,
    ),
)
def detector_thresholds(spark, folder):
    return D.thresholds(_labelled(spark, folder)).select("format", "threshold", F.round("f1", 9).alias("f1"))


@query(
    "parser_stats",
    O.lines(rf"""select 'syslog' format, count(*) total_parsed, count(*) filter (regexp_matches(raw, '{_SYSLOG}')) success_count, count(*) filter (not regexp_matches(raw, '{_SYSLOG}')) failure_count from raw_lines
    union all select format, count(*), count(*), 0 from detected where format <> 'syslog' group by format""", DETECTED),
)
def parser_stats(spark, folder):
    free = P.parser_stats(_parsed(spark, folder)).filter("format <> 'syslog'")
    return P.parser_stats(_forced(spark, folder, "syslog")).unionByName(free)


