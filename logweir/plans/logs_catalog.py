"""Queries over the logs table: selection, reports, SQL, mining, alerts, filters, limits, sinks, streams."""

from __future__ import annotations

import datetime
import hashlib
import json

from pyspark.sql import DataFrame, functions as F

from logweir.operators import alerts as A, changepoints as P, detectors as T, filters as L, mining as M, quality as K, query as Q, ratelimit as B, reports as R, search_index as X, similar as C, sketches as H, strategy as S
from logweir.operators.alerts import AlertRule
from logweir.operators.filters import CompositeFilter, FilterConfig, FilterRule
from logweir.operators.model import Action, Condition, Rule
from logweir.operators.parse import parse_as
from logweir.operators.rules import Options, apply_rules
from logweir.operators.strategy import Strategy, StrategyRule
from logweir.plans import oracle as O
from logweir.plans.registry import json_field, query, time_text
from logweir.plans.rules_catalog import leaf, rule
from logweir.plans.lines_catalog import DETECTED, PARSED_LINES
from logweir.schemas import DOCUMENTS, RULE_STORE
from logweir.session import materialise, scratch
from logweir.sources import ingest, readers, sinks, stores, views
from logweir.streaming import alerts as stream_alerts, pipeline, ratelimit as stream_limits, templates

NOW = "2024-01-31 00:00:00"
_TS = f'strftime("timestamp", {O.TIME}) ts'


def _logs(spark, folder) -> DataFrame:
    return views.logs(spark, folder)


# ---- selection ----


@query(
    "query_logs",
    O.logs(
        f"""select id, {_TS}, level, message, (select count(*) from logs where service = 'api-gateway' and component = 'sdk' and "timestamp" >= timestamp '2024-01-05' and "timestamp" <= timestamp '2024-01-25') total
        from logs where service = 'api-gateway' and component = 'sdk' and "timestamp" >= timestamp '2024-01-05' and "timestamp" <= timestamp '2024-01-25' order by "timestamp" desc, id desc limit 50 offset 20"""
    ),
)
def query_logs(spark, folder):
    page = Q.query_logs(_logs(spark, folder), service="api-gateway", component="sdk", start="2024-01-05", end="2024-01-25", limit=50, offset=20)
    return page.select("id", time_text("timestamp").alias("ts"), "level", "message", "total")


@query("query_logs_past_the_end", O.logs("select cast(null as bigint) id, count(*) total from logs where service = 'api-gateway'"))
def query_logs_past_the_end(spark, folder):
    return Q.query_logs(_logs(spark, folder), service="api-gateway", offset=1_000_000_000).select("id", "total")


@query(
    "query_logs_middle",
    O.logs(f"""select id, {_TS}, (select count(*) from logs where level <> 'DEBUG') total from logs where level <> 'DEBUG' order by "timestamp" desc, id desc
        limit (select count(*) // 4 from logs) offset (select count(*) // 2 from logs)"""),
)
def query_logs_middle(spark, folder):
    """A page far inside the table, long as it is: the quarter after the newer half."""
    logs = _logs(spark, folder)
    rows = logs.count()
    return Q.query_filters(logs, {"level": ["ERROR", "WARN", "INFO"]}, limit=rows // 4, offset=rows // 2).select("id", time_text("timestamp").alias("ts"), "total")


@query("search", O.logs(f"select id, {_TS}, message, count(*) over () total from logs where contains(lower(message), 'timeout after 1')"))
def search(spark, folder):
    return Q.search(_logs(spark, folder), "TimeOut after 1").select("id", time_text("timestamp").alias("ts"), "message", "total")


@query("search_indexed", O.logs(f"select id, {_TS}, message, count(*) over () total from logs where contains(lower(message), '17 200 2')"))
def search_indexed(spark, folder):
    """Logs arrive as two batches that share their hours; then a text is searched in the blocks that can hold it."""
    path, logs = scratch(spark, "indexed"), _logs(spark, folder).drop("fields")
    for batch, part in enumerate((F.col("level") == "INFO", F.col("level") != "INFO")):
        X.append(logs.filter(part), path, batch, columns=("message", "path"), seconds=86400)
    return X.search_indexed(spark, path, "17 200 2").select("id", time_text("timestamp").alias("ts"), "message", "total")


@query(
    "search_columns",
    O.logs("select id, count(*) over () total from logs where contains(lower(message), 'click') or contains(lower(path), 'click') or contains(user_id, 'click') order by \"timestamp\" desc, id desc limit 40 offset 10"),
)
def search_columns(spark, folder):
    return Q.search(_logs(spark, folder), "CLICK", columns=("message", "path", "user_id"), limit=40, offset=10).select("id", "total")


@query("query_filters", O.logs("select id, level, service, count(*) over () total from logs where level in ('ERROR', 'WARN') and service = 'order-service' and k = 7 and contains(lower(message), 'a')"))
def query_filters(spark, folder):
    return Q.query_filters(_logs(spark, folder), {"level": ["ERROR", "WARN"], "service": "order-service", "k": 7}, text="A").select("id", "level", "service", "total")


@query(
    "aggregate_by_field",
    O.logs(
        """select strftime(time_bucket(interval '1 day', "timestamp"), '%Y-%m-%d') as "day", cast(k as varchar) as value, count(*) total, count(*) filter (level = 'ERROR') errors,
        round(count(*) filter (level = 'ERROR') / count(*), 9) error_rate from logs where service in ('api-gateway', 'auth-service') group by 1, 2"""
    ),
)
def aggregate_by_field(spark, folder):
    out = Q.aggregate_by(_logs(spark, folder), "k", interval="1 day", filters={"service": ["api-gateway", "auth-service"]})
    return out.select(F.date_format("bucket", "yyyy-MM-dd").alias("day"), "value", "total", "errors", F.round("error_rate", 9).alias("error_rate"))


@query("like_escaped", O.logs(r"select id, message from logs where contains(message, 'user_id=u_1') or contains(message, '%')"))
def like_escaped(spark, folder):
    logs = _logs(spark, folder)
    return Q.like_escaped(logs, "user_id=u_1").unionByName(Q.like_escaped(logs, "%")).select("id", "message")


@query(
    "aggregate_overview",
    O.logs(
        """select dimension, value, count(*) total, count(*) filter (level = 'ERROR') errors, round(count(*) filter (level = 'ERROR') / count(*), 9) error_rate from (
        select 'all' dimension, '' as value, level from logs union all select 'level', level, level from logs union all select 'service', service, level from logs) group by 1, 2"""
    ),
)
def aggregate_overview(spark, folder):
    return Q.aggregate_overview(_logs(spark, folder)).withColumn("error_rate", F.round("error_rate", 9))


@query(
    "aggregate_by_interval",
    O.logs(
        f"""select strftime(time_bucket(interval '6 hours', "timestamp"), {O.TIME}) bucket, service, count(*) total, count(*) filter (level = 'ERROR') errors,
        round(count(*) filter (level = 'ERROR') / count(*), 9) error_rate from logs group by 1, 2"""
    ),
)
def aggregate_by_interval(spark, folder):
    out = Q.aggregate_by_interval(_logs(spark, folder), "6 hours")
    return out.select(time_text("bucket").alias("bucket"), "service", "total", "errors", F.round("error_rate", 9).alias("error_rate"))


# ---- named SQL ----

_NOW = f"timestamp '{NOW}'"


def _named(name: str, sql: str, *columns: str, **params) -> None:
    @query(f"sql_{name}", O.logs(sql))
    def job(spark, folder):
        out = Q.run_template(_logs(spark, folder), name, now=datetime.datetime.fromisoformat(NOW), **params)
        return out.select(*columns)


_named("recent_errors", f"select id, service, message from logs where level = 'ERROR' and \"timestamp\" > {_NOW} - interval 1 hour order by \"timestamp\" desc, id desc limit 100", "id", "service", "message")
_named("errors_by_service", f"select service, count(*) error_count from logs where level = 'ERROR' and \"timestamp\" > {_NOW} - interval 24 hour group by service", "service", "error_count")
_named("trace_logs", "select id, message from logs where trace_id = substr(md5('7'), 1, 16)", "id", "message", trace_id=hashlib.md5(b"7").hexdigest()[:16])
_named("slow_requests", f"select id, duration_ms from logs where duration_ms > 1000 and \"timestamp\" > {_NOW} - interval 1 hour order by duration_ms desc, id limit 50", "id", "duration_ms")
_named("latest_errors", "select id, message from logs where level = 'ERROR' order by \"timestamp\" desc, id desc limit 100", "id", "message")
_named("by_service", f"select service, count(*) \"count\" from logs where \"timestamp\" > {_NOW} - interval 1 hour group by service", "service", "count")
_named("by_level", 'select level, count(*) "count" from logs group by level', "level", "count")
_named("active_users", "select user_id, count(*) request_count from logs where event_type = 'click' group by user_id order by request_count desc, user_id limit 10", "user_id", "request_count", event_type="click")


@query("sql_any", O.logs("select service, level, count(*) n, cast(min(duration_ms) as double) fastest from logs where k between 10 and 60 group by service, level having count(*) > 2 order by n desc, service, level limit 20 offset 2"))
def sql_any(spark, folder):
    logs = _logs(spark, folder).withColumn("k", F.try_variant_get(F.try_element_at("fields", F.lit("k")), "$", "bigint"))
    return Q.sql(
        logs, "select service, level, count(*) n, min(duration_ms) fastest from logs where k between 10 and 60 group by service, level having count(*) > 2 order by n desc, service, level limit 20 offset 2"
    )


# ---- reports ----


@query(
    "top_lines",
    O.logs(
        """select path file, "function", line_number, count(*) "count", round(count(*) / (select count(*) from logs where service = 'order-service') * 100, 9) percentage,
        cast((select count(*) from logs where service = 'order-service') as bigint) total_logs from logs where service = 'order-service' and component = 'sdk' and "timestamp" >= timestamp '2024-01-03'
        group by path, "function", line_number order by "count" desc, path, "function", line_number limit 10"""
    ),
)
def top_lines(spark, folder):
    out = R.top_lines(_logs(spark, folder), "order-service", component="sdk", start="2024-01-03", limit=10)
    return out.withColumn("percentage", F.round("percentage", 9))


_SERVICE = "payment-service"
_SERVICE_GROUPS = f"""mine as (select *, {O.key()} grp from logs where service = '{_SERVICE}'),
heads as (select grp, arg_min(message, ("timestamp", id)) first_message from mine group by grp),
members as (select m.*, {O.template('first_message')} pattern from mine m join heads h on m.grp = h.grp),
counted as (select pattern, count(*) n from members group by pattern)"""


@query(
    "top_patterns",
    O.logs(
        f"""select c.pattern, n "count", round(n / (select count(*) from mine) * 100, 9) percentage, array_to_string(list(message order by "timestamp", id)[1:3], '|') samples
        from (select * from counted order by n desc, pattern limit 10) c join members m on m.pattern = c.pattern group by c.pattern, n""",
        _SERVICE_GROUPS,
    ),
)
def top_patterns(spark, folder):
    out = R.top_patterns(_logs(spark, folder), _SERVICE)
    return out.select("pattern", "count", F.round("percentage", 9).alias("percentage"), F.array_join("sample_logs", "|").alias("samples"))


@query(
    "report",
    O.logs(
        f"""select 'lines' section, concat(path, ':', "function", ':', cast(line_number as varchar)) as label, count(*) "count", round(count(*) / (select count(*) from mine) * 100, 9) percentage from mine group by path, "function", line_number order by "count" desc, path, "function", line_number limit 10""",
        _SERVICE_GROUPS,
    ).replace("select 'lines'", "select * from (select 'lines'", 1)
    + """) union all select * from (select 'patterns', pattern, n, round(n / (select count(*) from mine) * 100, 9) from counted order by n desc, pattern limit 10)""",
)
def report(spark, folder):
    out = R.report(_logs(spark, folder), _SERVICE)
    return out.select("section", "label", "count", F.round("percentage", 9).alias("percentage"))


@query("report_stored", O.logs(f"select '{_SERVICE}' service, 'processor' component, count(*) total_logs, cast(10 as bigint) listed from logs where service = '{_SERVICE}'"))
def report_stored(spark, folder):
    row = R.report_row(R.report(_logs(spark, folder), _SERVICE), _SERVICE, "processor")
    return row.select("service", "component", "total_logs", F.json_array_length("top_lines").cast("bigint").alias("listed"))


@query(
    "normalize_patterns",
    O.logs(
        r"""select pattern, count(*) "count", floor(count(*) * 100.0 / (select count(*) from logs where service = 'user-service') * 10 + 0.5) / 10 percentage from (
        select regexp_replace(regexp_replace(regexp_replace(regexp_replace(message, '\b0x[0-9a-fA-F]+\b', '{hex}', 'g'), '\b\d{2,}\b', '{n}', 'g'), 'u_\d+', 'u_{n}', 'g'), 'tr_[0-9a-f]+', 'tr_{id}', 'g') pattern
        from logs where service = 'user-service') group by pattern order by "count" desc, pattern limit 10"""
    ),
)
def normalize_patterns(spark, folder):
    return Q.normalize_patterns(_logs(spark, folder), "user-service")


# ---- mining ----


@query("tokenize", f"select doc_id, cast(len(t) as bigint) n, md5(array_to_string(t, ' ')) tokens from (select doc_id, {O.tokens('text')} t from documents)")
def tokenize(spark, folder):
    docs = views.table(spark, folder, "documents").withColumn("t", M.tokenize(F.col("text")))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query("message_template", O.logs(f"select id, {O.template()} as template from logs"))
def message_template(spark, folder):
    return views.logs(spark, folder).select("id", M.template(F.col("message")).alias("template"))


_SEVERITY = "case when frequency > 100 then 'high' when frequency > 50 then 'medium' else 'low' end"
_STATS = f"select substr(sha256(pattern), 1, 16) id, pattern, frequency, {_SEVERITY} severity from patterns"


@query("mine_patterns", O.mined(_STATS))
def mine_patterns(spark, folder):
    return M.mine_patterns(views.logs(spark, folder))


@query("mine_patterns_wildcard")
def mine_patterns_wildcard(spark, folder):
    return M.mine_patterns_wildcard(_logs(spark, folder))


@query(
    "pattern_stats",
    O.mined(
        f"""select substr(sha256(p.pattern), 1, 16) id, p.pattern, frequency, {_SEVERITY} severity, examples from patterns p join (
        select {O.template('g.first_message')} pattern, array_to_string(list(message order by "timestamp", id)[1:3], '|') examples from keyed k join grouped g on k.grp = g.grp group by 1) e on e.pattern = p.pattern"""
    ),
)
def pattern_stats(spark, folder):
    return M.pattern_stats(views.logs(spark, folder)).withColumn("examples", F.array_join("examples", "|"))


_SPLIT = "timestamp '2024-01-06'"


@query("anomalies", O.logs(f"select id, message from keyed k where \"timestamp\" >= {_SPLIT} and grp not in (select grp from keyed where \"timestamp\" < {_SPLIT})", O.KEYED))
def anomalies(spark, folder):
    logs, day = views.logs(spark, folder), F.to_timestamp_ntz(F.lit("2024-01-06"))
    return M.anomalies(logs.filter(F.col("timestamp") >= day), logs.filter(F.col("timestamp") < day)).select("id", "message")


@query("clusters", O.mined("select substr(sha256(pattern), 1, 16) id, pattern center, frequency size, 1.0::double similarity from patterns where frequency >= 2"))
def clusters(spark, folder):
    return M.clusters(views.logs(spark, folder))


@query(
    "clusters_similar",
    O.mined(
        """select min(id) id, arg_min(pattern, (-frequency, pattern)) center, count(*) templates, cast(sum(frequency) as bigint) size, coalesce(min(similarity), 1.0) similarity
        from (select n.*, r.root, l.similarity from named n join (select x, min(y) root from reach group by x) r on r.x = n.id left join (select x, min(similarity) similarity from links group by x) l on l.x = n.id)
        group by root having sum(frequency) >= 2""",
        "named as (select substr(sha256(pattern), 1, 16) id, pattern, frequency, list_distinct(string_split(pattern, ' ')) t from patterns)",
        """links as (select * from (select a.id x, b.id y, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::double similarity from named a join named b on a.id <> b.id) where similarity >= 0.7 - 1e-9)""",
        "reach as (select id x, id y from named union select r.x, l.y from reach r join links l on r.y = l.x)",
    ).replace("with logs", "with recursive logs", 1),
)
def clusters_similar(spark, folder):
    return C.mine_clusters(views.logs(spark, folder), 0.7)


@query(
    "cluster_members",
    O.mined(f"select k.id, substr(sha256(p.pattern), 1, 16) cluster_id from keyed k join (select grp, {O.template('first_message')} pattern from grouped) g on k.grp = g.grp join patterns p on p.pattern = g.pattern where p.frequency >= 2"),
)
def cluster_members(spark, folder):
    return M.cluster_members(views.logs(spark, folder)).select("id", "cluster_id")


_RECOMMENDED = f"""select substr(sha256(pattern), 1, 16) pattern_id, concat('Auto-generated rule for: ', case when strlen(pattern) <= 50 then pattern else concat(substr(pattern, 1, 50), '...') end) "name",
 cast(case when frequency > 100 then 1 else 2 end as bigint) priority, 'matches' as "operator", 'mark' as "action", concat('{{"value":"', substr(sha256(pattern), 1, 16), '"}}') config, frequency from patterns where frequency > 50 and frequency >= 10"""


@query("recommend_rules", O.mined(_RECOMMENDED))
def recommend_rules(spark, folder):
    out = M.recommend_rules(M.mine_patterns(views.logs(spark, folder)))
    return out.select("pattern_id", "name", F.col("priority").cast("bigint").alias("priority"), "operator", "action", "config", "frequency")


@query(
    "closed_loop",
    O.mined(
        f"""select k.id, case when p.frequency > 50 then substr(sha256(p.pattern), 1, 16) else 'new' end tag from keyed k
        join (select grp, {O.template('first_message')} pattern from grouped) g on k.grp = g.grp join patterns p on p.pattern = g.pattern where k.level <> 'DEBUG'"""
    ),
)
def closed_loop(spark, folder):
    """Whole messages are mined, every recommendation marks exactly the rows of its pattern, and a rule drops what is left of the noise."""
    logs = views.logs(spark, folder)
    marked = M.mark_rows(logs, M.recommend_rules(M.mine_patterns(logs)))
    drop = rule("zz", leaf("level", "eq", "DEBUG"), ("drop", {}))
    return apply_rules(marked, [drop]).select("id", F.coalesce("tag", F.lit("new")).alias("tag"))


_TEMPLATE_TABLE = f"""early as (select grp, count(*) n, arg_min(message, ("timestamp", id)) m from keyed where "timestamp" < timestamp '2024-01-15' group by grp),
late as (select grp, count(*) n, arg_min(message, ("timestamp", id)) m from keyed where "timestamp" >= timestamp '2024-01-15' group by grp)"""


@query(
    "patterns_incremental",
    O.logs(f"select pattern, cast(sum(n) as bigint) frequency from (select {O.template('coalesce(e.m, l.m)')} pattern, coalesce(e.n, 0) + coalesce(l.n, 0) n from early e full join late l on e.grp = l.grp) group by pattern", O.KEYED, _TEMPLATE_TABLE),
)
def patterns_incremental(spark, folder):
    logs, path, day = views.logs(spark, folder), scratch(spark, "templates"), F.to_timestamp_ntz(F.lit("2024-01-15"))
    templates.absorb(logs.filter(F.col("timestamp") < day), path, 0)
    return templates.patterns(templates.absorb(logs.filter(F.col("timestamp") >= day), path, 1)).select("pattern", "frequency")


# ---- time-series findings ----


def _trail(seconds: int, counts: str, agg: str, span: int) -> str:
    return f"""select *, {agg} over (partition by service order by bucket range between {span} preceding and 1 preceding) trail from (
    select service, cast(floor(epoch("timestamp") / {seconds}) as bigint) bucket, {counts} from logs"""


@query("detect_error_spike", O.logs(f"select service, bucket, errors, round(coalesce(trail, 0) / 24, 9) expected from ({_trail(3600, 'count(*) errors', 'sum(errors)', 24)} where level = 'ERROR' group by 1, 2)) where errors >= 3 and errors >= coalesce(trail, 0) / 24 * 3"))
def detect_error_spike(spark, folder):
    return T.error_spikes(_logs(spark, folder)).withColumn("expected", F.round("expected", 9))


@query(
    "detect_frequency_change",
    O.logs(f"select service, bucket, total, round(trail / 3, 9) expected, case when total >= trail / 3 * 1.2 then 'up' else 'down' end direction from ({_trail(86400, 'count(*) total', 'sum(total)', 3)} group by 1, 2)) where trail is not null and (total >= trail / 3 * 1.2 or total * 1.2 <= trail / 3)"),
)
def detect_frequency_change(spark, folder):
    return T.frequency_changes(_logs(spark, folder)).withColumn("expected", F.round("expected", 9))


@query(
    "detect_slow_response",
    O.logs(f"select service, bucket, round(observed, 6) observed, round(trail, 6) expected from ({_trail(86400, 'quantile_disc(duration_ms, 0.95) observed', 'avg(observed)', 3)} group by 1, 2)) where observed >= trail * 1.1"),
)
def detect_slow_response(spark, folder):
    out = T.slow_responses(_logs(spark, folder))
    return out.withColumns({"observed": F.round("observed", 6), "expected": F.round("expected", 6)})


@query(
    "detect_new_pattern",
    O.logs(f"select {O.template('m')} pattern, cast(sum(n) as bigint) frequency from (select grp, count(*) n, arg_min(message, (\"timestamp\", id)) m from keyed where \"timestamp\" >= {_SPLIT} and grp not in (select grp from keyed where \"timestamp\" < {_SPLIT}) group by grp) group by 1", O.KEYED),
)
def detect_new_pattern(spark, folder):
    return T.new_patterns(views.logs(spark, folder), F.to_timestamp_ntz(F.lit("2024-01-06"))).select("pattern", "frequency")


# order-service writes four times as much for three days, payment-service a third of what it usually does for three others
_MORE, _LESS = ("2024-01-12", "2024-01-15"), ("2024-01-20", "2024-01-23")
_COPIES = """case when service = 'order-service' and "timestamp" >= timestamp '{0}' and "timestamp" < timestamp '{1}' then 4
  when service = 'payment-service' and not ("timestamp" >= timestamp '{2}' and "timestamp" < timestamp '{3}') then 3 else 1 end""".format(*_MORE, *_LESS)
_CHANGES = f"""shifted as (select service, "timestamp", unnest(range({_COPIES})) from logs),
counts as (select service, cast(floor(epoch("timestamp") / 21600) as bigint) bucket, count(*) n from shifted group by 1, 2),
filled as (select s.service, s.bucket, coalesce(c.n, 0) n from (select service, unnest(range(min(bucket), max(bucket) + 1)) bucket from counts group by service) s left join counts c using (service, bucket)),
middle as (select *, median(n) over (partition by service, bucket % 28) m from filled),
usual as (select *, median(abs(n - m)) over (partition by service, bucket % 28) mad from middle),
scored as (select service, bucket, n, m, cast(greatest(-4000, least(4000, floor(cast(1000 as double) * (n - m) / greatest(cast(1.4826 as double) * mad, sqrt(greatest(m, 1)))))) as bigint) away from usual),
steps as (select *, row_number() over (partition by service, direction order by bucket) i from (
  select service, 'up' direction, bucket, n, m, away - 1000 step from scored union all select service, 'down', bucket, n, m, -away - 1000 from scored)),
walk as (select service, direction, i, bucket, n, m, greatest(0, least(16000, step)) level from steps where i = 1
  union all select s.service, s.direction, s.i, s.bucket, s.n, s.m, greatest(0, least(16000, w.level + s.step)) from walk w join steps s on s.service = w.service and s.direction = w.direction and s.i = w.i + 1),
stretches as (select * from (select *, count(*) filter (level = 0) over (partition by service, direction order by i) part, max(bucket) over (partition by service, direction) final from walk) where level > 0),
peaks as (select *, max(level) over (partition by service, direction, part) top from stretches),
ends as (select *, max(bucket) filter (level = top) over (partition by service, direction, part) peak from peaks),
found as (select service, direction, part, min(bucket) onset, min(bucket) filter (level >= 8000) alarm, any_value(peak) peak, max(bucket) = any_value(final) still,
  sum(n) filter (bucket <= peak) observed, sum(m) filter (bucket <= peak) expected from ends group by 1, 2, 3)"""


@query(
    "detect_change_point",
    O.logs(
        f"""select service, direction, strftime(make_timestamp(onset * 21600000000), {O.TIME}) onset, strftime(make_timestamp(alarm * 21600000000), {O.TIME}) alarm,
        case when not still then strftime(make_timestamp((peak + 1) * 21600000000), {O.TIME}) end "end", cast(observed as bigint) observed, expected from found where alarm is not null""",
        _CHANGES,
    ).replace("with ", "with recursive ", 1),
)
def detect_change_point(spark, folder):
    logs = _logs(spark, folder).withColumn("copy", F.explode(F.sequence(F.lit(1), F.expr(_COPIES.replace('"timestamp"', "`timestamp`").replace("timestamp '", "timestamp_ntz '")))))
    found = P.change_points(logs, seconds=21600, period=28)
    return found.withColumns({c: time_text(c) for c in ("onset", "alarm", "end")})


# ---- alerts ----

ALERTS = [
    AlertRule("gateway-errors", "gateway errors", True, "api-gateway", Condition("level", "eq", "ERROR"), 2, 3600),
    AlertRule("slow", "slow rows", True, "", Condition.parse({"all": [leaf("duration_ms", "gt", 1500), leaf("level", "ne", "DEBUG")]}), 3, 7200),
    AlertRule("off", "disabled", False, "", Condition("level", "eq", "INFO"), 1, 60),
]
_FIRED = """fired as (select rule_id, service, start, win, count(*) n from (
  select 'gateway-errors' rule_id, 'api-gateway' service, cast(floor(epoch("timestamp") / 3600) * 3600 as bigint) start, cast(3600 as bigint) win from logs where service = 'api-gateway' and level = 'ERROR'
  union all select 'slow', '', cast(floor(epoch("timestamp") / 7200) * 7200 as bigint), cast(7200 as bigint) from logs where duration_ms > 1500 and level <> 'DEBUG')
  group by all having n >= case rule_id when 'slow' then 3 else 2 end)"""
_FIRED_COLUMNS = """sha256(concat(rule_id, ':', cast(start as varchar))) id, rule_id, service, start + win trigger_time, n "count", win "window\""""


def _alert_columns(alerts: DataFrame) -> DataFrame:
    return alerts.select("id", "rule_id", "service", F.unix_seconds("trigger_time").alias("trigger_time"), "count", "window")


@query("alerts_eval", O.logs(f"select {_FIRED_COLUMNS} from fired", _FIRED))
def alerts_eval(spark, folder):
    return _alert_columns(A.evaluate(_logs(spark, folder), ALERTS))


@query("alerts_rules_table", O.logs(f"select {_FIRED_COLUMNS} from fired", _FIRED))
def alerts_rules_table(spark, folder):
    """The alert rules come from a table; a document that is no rule is reported."""
    bodies = [
        {"id": r.id, "name": r.name, "enabled": r.enabled, "service": r.service, "threshold": r.threshold, "window": r.window, "condition": c}
        for r, c in zip(
            ALERTS,
            (leaf("level", "eq", "ERROR"), {"all": [leaf("duration_ms", "gt", 1500), leaf("level", "ne", "DEBUG")]}, leaf("level", "eq", "INFO")),
            strict=True,
        )
    ]
    store = spark.createDataFrame([(b["id"], "", json.dumps(b)) for b in bodies] + [("bad", "", "[1]")], RULE_STORE)
    assert stores.rejects(store).count() == 1
    return _alert_columns(A.evaluate(_logs(spark, folder), stores.load_alert_rules(store)))


@query("alerts_history", O.logs(f"select {_FIRED_COLUMNS}, case when n % 2 = 0 then 'resolved' else 'pending' end status from fired", _FIRED))
def alerts_history(spark, folder):
    found = A.evaluate(_logs(spark, folder), ALERTS)
    early = found.select(F.col("id").alias("alert_id"), F.lit("pending").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("changed_at"))
    changes = early.unionByName(A.resolve(found.filter("count % 2 = 0"), F.lit(NOW)))
    out = A.history(found, changes)
    return out.select("id", "rule_id", "service", F.unix_seconds("trigger_time").alias("trigger_time"), "count", "window", "status")


@query(
    "alerts_volume",
    O.logs("select sha256(concat('volume:', cast(start as varchar))) id, n \"count\" from (select cast(floor(epoch(\"timestamp\") / 21600) * 21600 as bigint) start, count(*) n from logs group by 1) where n >= 10"),
)
def alerts_volume(spark, folder):
    return A.evaluate(_logs(spark, folder), [A.volume_rule("volume", threshold=10, window=21600)]).select("id", "count")


_SECONDS = """seconds as (select rule_id, service, win, sec, count(*) n from (
  select 'gateway-errors' rule_id, 'api-gateway' service, cast(3600 as bigint) win, cast(floor(epoch("timestamp")) as bigint) sec from logs where service = 'api-gateway' and level = 'ERROR'
  union all select 'slow', '', cast(7200 as bigint), cast(floor(epoch("timestamp")) as bigint) from logs where duration_ms > 1500 and level <> 'DEBUG') group by all),
slid as (select *, sum(n) over (partition by rule_id order by sec range between 3599 preceding and current row) c1, sum(n) over (partition by rule_id order by sec range between 3600 preceding and 1 preceding) b1,
  sum(n) over (partition by rule_id order by sec range between 7199 preceding and current row) c2, sum(n) over (partition by rule_id order by sec range between 7200 preceding and 1 preceding) b2 from seconds),
started as (select rule_id, service, win, sec, cast(case rule_id when 'slow' then c2 else c1 end as bigint) n, coalesce(case rule_id when 'slow' then b2 else b1 end, 0) b, case rule_id when 'slow' then 3 else 2 end t from slid)"""
_STARTED = """select sha256(concat(rule_id, ':', cast(sec as varchar))) id, rule_id, service, sec trigger_time, n "count", win "window" from started where n >= t and b < t"""


@query("alerts_sliding", O.logs(_STARTED, _SECONDS))
def alerts_sliding(spark, folder):
    return _alert_columns(A.evaluate_sliding(_logs(spark, folder), ALERTS))


@query("alerts_sliding_stream", O.logs(_STARTED, _SECONDS))
def alerts_sliding_stream(spark, folder):
    path = scratch(spark, "sliding")
    logs = views.logs_from_events(readers.stream_table(spark, folder, "events"))
    stream_alerts.start_sliding(logs, ALERTS, f"{path}/out", f"{path}/state", f"{path}/checkpoint", trigger={"availableNow": True}).awaitTermination()
    return _alert_columns(stream_alerts.read_sliding(spark, f"{path}/out"))


# ---- figures ----


@query(
    "latency_stats",
    O.logs(
        """select service, n "count", round(a, 6) "avg", lo "min", hi "max", v[n * 50 // 100 + 1] p50, v[n * 95 // 100 + 1] p95, v[n * 99 // 100 + 1] p99 from (
        select service, count(*) n, avg(duration_ms) a, min(duration_ms) lo, max(duration_ms) hi, list(duration_ms order by duration_ms) v from logs group by service)"""
    ),
)
def latency_stats(spark, folder):
    return K.latency_stats(_logs(spark, folder), "duration_ms", ("service",)).withColumn("avg", F.round("avg", 6))


@query("latency_total", O.logs('select n "count", v[n * 50 // 100 + 1] p50, v[n * 95 // 100 + 1] p95, v[n * 99 // 100 + 1] p99 from (select count(*) n, list(duration_ms order by duration_ms) v from logs)'))
def latency_total(spark, folder):
    return K.latency_stats(_logs(spark, folder), "duration_ms").select("count", "p50", "p95", "p99")


@query(
    "latency_sketched",
    O.logs('select service, count(*) "count", round(avg(duration_ms), 6) "avg", min(duration_ms) "min", max(duration_ms) "max", true p50_near, true p95_near, true p99_near from logs group by service'),
)
def latency_sketched(spark, folder):
    """Sketches of two batches that share their hours; the percentiles' true ranks must be within the stated error."""
    path, logs = scratch(spark, "sketches"), _logs(spark, folder)
    for batch, part in enumerate((F.col("level") == "INFO", F.col("level") != "INFO")):
        H.absorb(H.sketch(logs.filter(part), "duration_ms"), path, batch)
    found = H.latency_sketched(H.read(spark, path)).transform(lambda df: materialise(df, "percentiles"))
    near = H.rank_errors(logs, "duration_ms", found, ("service",)).select("service", *[(F.col(f"e{p}") <= H.RANK_ERROR).alias(f"p{p}_near") for p in K.PERCENTS])
    return found.join(near, "service").select("service", "count", F.round("avg", 6).alias("avg"), "min", "max", *[f"p{p}_near" for p in K.PERCENTS])


@query("latency_last_n", O.logs('select id, service, duration_ms from logs qualify row_number() over (partition by service order by "timestamp" desc, id desc) <= 100'))
def latency_last_n(spark, folder):
    return K.last_n(_logs(spark, folder), 100, ("service",)).select("id", "service", "duration_ms")


@query(
    "pipeline_metrics",
    O.lines(
        """, p as (select json_valid(raw) parsed, case when json_valid(raw) then json_extract_string(raw, '$.level') <> 'INFO' else false end kept, logged_at from raw_lines)
        select count(*) parse_count, count(*) filter (parsed) parse_success, count(*) filter (not parsed) parse_failure, count(*) filter (parsed) filter_count, count(*) filter (kept) filter_kept,
        count(*) filter (parsed and not kept) filter_dropped, round(count(*) filter (parsed and not kept) * 100.0 / count(*) filter (parsed), 9) filter_rate, round(count(*) filter (parsed) * 100.0 / count(*), 9) success_rate,
        round(count(*) / (floor(epoch(max(logged_at))) - floor(epoch(min(logged_at)))), 9) throughput from p"""
    ),
)
def pipeline_metrics(spark, folder):
    parsed = parse_as(views.raw_lines(spark, folder), "json", ingest_ts=F.col("logged_at"))
    decided = parsed.withColumn("should_keep", F.col("level") != "INFO")
    out = K.pipeline_metrics(decided, time="logged_at")
    return out.withColumns({c: F.round(c, 9) for c in ("filter_rate", "success_rate", "throughput")})


# ---- filters ----

FILTERS = [
    FilterConfig("b", True, 5, "", "", (FilterRule("clicks", "message", r"^POST \S+ 404", "drop"), FilterRule("slow", "message", "slow query", "mark"))),
    FilterConfig("a", True, 5, "auth-service", "", (FilterRule("debug", "level", "^DEBUG$", "drop"), FilterRule("nine", "k", "^9", "mark"))),
    FilterConfig("c", True, 9, "", "", (FilterRule("errors", "level", "ERROR|WARN", "mark"), FilterRule("broken", "message", "(?=x)", "drop"))),
    FilterConfig("d", False, 99, "", "", (FilterRule("all", "message", ".", "drop"),)),
]
# order: c, a, b
_FLAGS = r"""flags as (select *, level in ('ERROR', 'WARN') m1, service = 'auth-service' and level = 'DEBUG' d1, service = 'auth-service' and k between 90 and 99 or (service = 'auth-service' and k = 9) m2,
  regexp_matches(message, '^POST \S+ 404') d2, contains(message, 'slow query') m3 from logs)"""
_DECIDED = """decided as (select id, service, "timestamp", not (d1 or d2) should_keep, case when d1 or d2 then 'drop' when m3 or m2 or m1 then 'mark' else 'allow' end filter_action,
  case when d1 then 'debug' when d2 then 'clicks' when m3 then 'slow' when m2 then 'nine' when m1 then 'errors' else '' end matched_rule,
  case when d1 then case when m1 then 'errors' end when d2 then case when m2 then 'nine' when m1 then 'errors' end when m3 then 'slow' when m2 then 'nine' when m1 then 'errors' end marked_by from flags)"""


def _filtered(spark, folder) -> DataFrame:
    return L.apply_filters(_logs(spark, folder), FILTERS)


@query("filter_engine", O.logs("select id, should_keep, filter_action, matched_rule, marked_by from decided", _FLAGS, _DECIDED))
def filter_engine(spark, folder):
    return _filtered(spark, folder).select("id", "should_keep", "filter_action", "matched_rule", "marked_by")


@query("filter_regex_any", O.logs(r"select id from logs where regexp_matches(message, '(\d)0ms$') or regexp_matches(service, '^auth')"))
def filter_regex_any(spark, folder):
    config = FilterConfig("x", rules=(FilterRule("a", "message", r"(\d)0ms$"), FilterRule("b", "service", "^auth"), FilterRule("c", "nowhere", "x")))
    return L.matches_any(_logs(spark, folder), config).select("id")


@query(
    "filter_composite",
    O.logs(
        r"""select id, not (level = 'ERROR' and user_id >= 'u_5') should_keep, case when level = 'ERROR' and user_id >= 'u_5' then 'late users' when service = 'api-gateway' or regexp_matches(message, '^GET') then 'watched' else '' end matched_rule from logs"""
    ),
)
def filter_composite(spark, folder):
    filters = [
        CompositeFilter("watched", "OR", (("service", "eq", "api-gateway"), ("message", "regex", "^GET"), ("message", "regex", "(?=x)")), "mark"),
        CompositeFilter("late users", "AND", (("level", "eq", "ERROR"), ("who", "ge", "u_5")), "drop"),
        CompositeFilter("none", "XOR", (("level", "ne", ""),), "drop"),
    ]
    logs = _logs(spark, folder)
    logs = logs.withColumn("fields", F.map_concat("fields", F.create_map(F.lit("who"), F.col("user_id").cast("variant"))))
    return L.apply_composite(logs, filters).select("id", "should_keep", "matched_rule")


_STAT_COLUMNS = "count(*) total_processed, count(*) filter (should_keep) total_kept, count(*) filter (not should_keep) total_dropped, count(*) filter (filter_action = 'mark') total_marked"


@query("filter_stats", O.logs(f"select {_STAT_COLUMNS} from decided", _FLAGS, _DECIDED))
def filter_stats(spark, folder):
    return L.filter_stats(_filtered(spark, folder))


@query("filter_stats_by_service", O.logs(f"select service, {_STAT_COLUMNS}, round(count(*) filter (not should_keep) / count(*), 9) drop_rate from decided group by service", _FLAGS, _DECIDED))
def filter_stats_by_service(spark, folder):
    return L.filter_stats_by_service(_filtered(spark, folder)).withColumn("drop_rate", F.round("drop_rate", 9))


@query("filter_recent", O.logs('select id, service, filter_action "action", matched_rule rule_name, should_keep kept from decided order by "timestamp" desc, id desc limit 50', _FLAGS, _DECIDED))
def filter_recent(spark, folder):
    return L.recent_decisions(_filtered(spark, folder), 50).drop("timestamp")


@query("pipeline_filter", O.lines("select id, 'json' format, json_extract_string(raw, '$.message') message, concat('{\"user_id\":\"', json_extract_string(raw, '$.user_id'), '\",\"tier\":\"gold\"}') fields from raw_lines where json_valid(raw) and json_extract_string(raw, '$.level') <> 'INFO'"))
def pipeline_filter(spark, folder):
    parsed = parse_as(views.raw_lines(spark, folder), "json", ingest_ts=F.col("logged_at")).filter("parsed")
    rules = [rule("a", leaf("level", "eq", "INFO"), ("drop", {})), rule("b", leaf("user_id", "starts_with", "u_"), ("set", {"field": "tier", "value": "gold"}))]
    edited = apply_rules(parsed, rules, Options(shadow=True))
    untouched = apply_rules(parsed, rules, Options(shadow=True, edits=False)).select("id", F.map_contains_key("fields", "tier").alias("_t"))
    # without edits only the decision counts
    return edited.join(untouched.filter("not _t").select("id"), "id", "left_semi").select("id", "format", "message", F.to_json("fields").alias("fields"))


@query("hook_level", O.logs("select id from logs where level in ('WARN', 'ERROR') and line_number between 20 and 40"))
def hook_level(spark, folder):
    # a plain predicate is a hook as well
    return L.apply_hooks(_logs(spark, folder), [L.level_hook("WARN"), F.col("line_number") >= 20, F.col("line_number") <= 40]).select("id")


@query("hook_regex", O.logs("select id from logs where regexp_matches(message, 'timeout|slow') and regexp_matches(cast(k as varchar), '^[1-4]')"))
def hook_regex(spark, folder):
    logs = _logs(spark, folder)
    hooks = [L.regex_hook(logs, "message", "timeout|slow"), L.regex_hook(logs, "k", "^[1-4]"), L.regex_hook(logs, "nowhere", "x")]
    return L.apply_hooks(logs, hooks).select("id")


@query("hook_line", O.logs("select id, line_number from logs where line_number between 15 and 30"))
def hook_line(spark, folder):
    return L.apply_hooks(_logs(spark, folder), [L.line_hook(15, 30)]).select("id", "line_number")


STRATEGIES = [
    Strategy("s2", "views", True, 1, (StrategyRule("views", "INFO", "", "", "pkg/v*.go", True, 0.25, "low", ""),)),
    Strategy("s1", "errors", True, 10, (StrategyRule("errors", "ERROR", "", "prod", "", True, 1.0, "high", "mask"), StrategyRule("quiet", "DEBUG", "auth-service", "", "", False))),
    Strategy("s3", "off", False, 99, (StrategyRule("all", enabled=False),)),
]
_STRATEGY_HASH = "('0x' || substr(md5(concat(cast(id as varchar), ':strategy:0')), 1, 8))::bigint / 4294967296.0"


@query(
    "strategy_decide",
    O.logs(
        f"""select id, not (level = 'DEBUG' and service = 'auth-service') and (event_type <> 'view' or {_STRATEGY_HASH} <= 0.25) should_log,
        case when event_type = 'view' then 0.25 else 1.0 end::double sampling, case when event_type = 'view' then 'low' when level = 'ERROR' then 'high' else 'normal' end priority,
        case when level = 'ERROR' then 'mask' else 'none' end as transform from logs"""
    ),
)
def strategy_decide(spark, folder):
    return S.decide(_logs(spark, folder).withColumn("environment", F.lit("prod")), STRATEGIES).select("id", "decision.*")


# a bucket of five per service, one more each hour; the level goes from hour to hour
_LIMITED = O.logs(
    "select id, service from (select *, row_number() over (partition by service, tick order by \"timestamp\", id) place from ticked) join levels using (service, tick) where place <= allowed",
    'ticked as (select id, service, "timestamp", epoch_ms("timestamp") // 3600000 tick from logs)',
    "counts as (select service, tick, count(*) n, row_number() over (partition by service order by tick) step from ticked group by 1, 2)",
    """levels as (select service, tick, step, least(5, n) allowed, 5 - least(5, n) left_over from counts where step = 1
    union all select c.service, c.tick, c.step, least(c.n, least(5, l.left_over + c.tick - l.tick)), least(5, l.left_over + c.tick - l.tick) - least(c.n, least(5, l.left_over + c.tick - l.tick))
    from levels l join counts c on c.service = l.service and c.step = l.step + 1)""",
).replace("with ", "with recursive ", 1)


@query("rate_limit", _LIMITED)
def rate_limit(spark, folder):
    return B.rate_limit(_logs(spark, folder), key="service", capacity=5, fill=1, tick_ms=3_600_000).select("id", "service")


# ---- sources and sinks ----


@query("src_raw_lines", O.lines("select count(*) n, count(distinct raw) lines from raw_lines"))
def src_raw_lines(spark, folder):
    """Lines written as text files and read back as a stream."""
    path = scratch(spark, "lines")
    views.raw_lines(spark, folder).select("raw").write.text(f"{path}/in")
    out = readers.stream_lines(spark, f"{path}/in").select("raw").writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
    out.trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema("raw string").parquet(f"{path}/out").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("raw").alias("lines"))


@query(
    "ingest_validate",
    O.logs("select case when service = 'content-service' then 'service is required' when id % 9 = 0 then 'timestamp is not a time' when id % 10 = 0 then 'fields is not an object' else 'ok' end outcome, count(*) n from logs group by 1"),
)
def ingest_validate(spark, folder):
    entries = _logs(spark, folder).select(
        F.nullif("service", F.lit("content-service")).alias("service"), "component",
        F.when(F.col("id") % 9 == 0, "yesterday").otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        "level", "message", "path", "function", "line_number", "trace_id", "user_id",
        F.when(F.col("id") % 10 == 0, "[1]").otherwise(F.col("fields_json")).alias("fields"),
    )
    good, bad = ingest.to_logs(entries, F.lit(NOW).cast("timestamp"))
    return good.groupBy(F.lit("ok").alias("outcome")).agg(F.count(F.lit(1)).alias("n")).unionByName(bad.groupBy(F.col("error").alias("outcome")).agg(F.count(F.lit(1)).alias("n")))


@query("sink_upsert_latest", O.logs("""select concat(service, '-', cast(epoch_us(date_trunc('hour', "timestamp")) * 1000 as varchar)) id, arg_max(message, id) message, max(id) seq from logs group by 1"""))
def sink_upsert_latest(spark, folder):
    docs = _logs(spark, folder).select(sinks.document_id(F.col("service"), F.date_trunc("hour", "timestamp")).alias("id"), "message", F.col("id").alias("seq"))
    return sinks.latest_per_id(docs, F.col("seq"))


@query(
    "sink_upsert",
    O.logs(
        """select concat(service, '-', cast(epoch_us(date_trunc('hour', "timestamp")) * 1000 as varchar)) id, coalesce(arg_max(message, id) filter (id % 3 <> 0), arg_max(message, id)) message,
        coalesce(max(id) filter (id % 3 <> 0), max(id)) seq from logs group by 1"""
    ),
)
def sink_upsert(spark, folder):
    """Two batches with ids in common: the second stands, and a repeated batch changes nothing."""
    path = scratch(spark, "upsert")
    docs = _logs(spark, folder).select(sinks.document_id(F.col("service"), F.date_trunc("hour", "timestamp")).alias("id"), F.date_trunc("hour", "timestamp").alias("timestamp"), "message", F.col("id").alias("seq"))
    for number, part in ((0, "seq % 3 = 0"), (1, "seq % 3 <> 0"), (0, "seq % 3 = 0")):
        sinks.upsert(docs.filter(part), path, F.col("seq"), number)
    return sinks.current(spark, path).select("id", "message", "seq")


@query("sink_multi", O.logs("select 'a' sink, count(*) n from logs union all select 'b', count(*) from logs"))
def sink_multi(spark, folder):
    path = scratch(spark, "multi")

    def broken(docs: DataFrame) -> None:
        raise OSError("unreachable")

    error = sinks.write_all(
        _logs(spark, folder).select("id", "service", "message"),
        [lambda d: d.write.parquet(f"{path}/a"), broken, lambda d: d.write.parquet(f"{path}/b")],
    )
    assert isinstance(error, OSError)
    schema = "id bigint, service string, message string"
    counts = [spark.read.schema(schema).parquet(f"{path}/{n}").groupBy(F.lit(n).alias("sink")).agg(F.count(F.lit(1)).alias("n")) for n in "ab"]
    return counts[0].unionByName(counts[1])


@query("alert_feed", O.logs("""select concat('{"id":', cast(id as varchar), ',"level":"', level, '","message":"', message, '"}') body from logs where level in ('ERROR', 'FATAL')"""))
def alert_feed(spark, folder):
    return sinks.alert_feed(_logs(spark, folder).select("id", "level", "message"))


@query(
    "topic_rows",
    O.logs("""select service as "key", concat('{"timestamp":"', strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ'), '","level":"', level, '","message":"', message, '","service":"', service, '","trace_id":"', trace_id, '","k":', cast(k as varchar), '}') as "value" from logs"""),
)
def topic_rows(spark, folder):
    return sinks.topic_rows(_logs(spark, folder))


# ---- streams ----


@query("alerts_stream", O.logs(f"select {_FIRED_COLUMNS} from fired", _FIRED))
def alerts_stream(spark, folder):
    path = scratch(spark, "alerts")
    logs = views.logs_from_events(readers.stream_table(spark, folder, "events"))
    for q in stream_alerts.start(logs, ALERTS, f"{path}/out", f"{path}/checkpoint", trigger={"availableNow": True}):
        q.awaitTermination()
    return _alert_columns(stream_alerts.read(spark, f"{path}/out"))


@query(
    "pipeline_stream",
    O.lines(
        f"select service, level, count(distinct concat(service, '|', ts, '|', raw)) documents, count(distinct raw) filter (format = 'unstructured') analysed from ({PARSED_LINES}) where level <> 'DEBUG' group by 1, 2",
        DETECTED,
    ),
)
def pipeline_stream(spark, folder):
    path = scratch(spark, "pipeline")
    lines = views.raw_lines_from_logs(views.logs_from_events(readers.stream_table(spark, folder, "events")))
    lines = lines.select("raw", F.col("logged_at").cast("timestamp").alias("ingest_ts"))

    def rules() -> list[Rule]:
        return [rule("a", leaf("level", "eq", "DEBUG"), ("drop", {}))]

    pipeline.start(lines, f"{path}/docs", f"{path}/checkpoint", load_rules=rules, trigger={"availableNow": True}).awaitTermination()
    found = sinks.current(spark, f"{path}/docs", DOCUMENTS)
    # every free line says that a connection was slow and failed
    mood = (F.col("sentiment_score") == -1.0) & (F.col("sentiment_label") == "negative") & (F.col("language") == "en") & (F.col("category") == "error")
    named = (F.get("keywords", F.lit(0)) == "connection") & (F.get("entities", F.lit(0))["type"] == "IP_ADDRESS")
    return found.groupBy("service", "level").agg(F.count(F.lit(1)).alias("documents"), F.count_if(mood & named).alias("analysed"))


@query("rate_limit_stream", _LIMITED)
def rate_limit_stream(spark, folder):
    path = scratch(spark, "limit")
    logs = views.logs_from_events(readers.stream_table(spark, folder, "events")).select("id", "service", "timestamp")
    stream_limits.start(
        logs, lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/out/batch={n}"), f"{path}/buckets", f"{path}/checkpoint",
        capacity=5, fill=1, tick_ms=3_600_000, trigger={"availableNow": True},
    ).awaitTermination()
    return spark.read.schema("id bigint, service string").parquet(f"{path}/out").select("id", "service")

