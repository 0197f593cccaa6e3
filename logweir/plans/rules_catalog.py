"""Queries over conditions, actions and rule sets."""

from __future__ import annotations

import datetime
import json
from dataclasses import replace

from pyspark.sql import Window, functions as F

from logweir.operators import query as Q, rule_index as X, rules as R, versions as V
from logweir.operators.actions import Effect
from logweir.operators.conditions import filter_where
from logweir.operators.model import Rule
from logweir.operators.rules import Options, apply_rules
from logweir.plans import oracle as O
from logweir.plans.registry import json_field, query
from logweir.schemas import RULE_VERSION
from logweir.sources import stores, views


def rule(id: str, condition: dict, *actions: tuple[str, dict], **more) -> Rule:
    doc = {"id": id, "name": f"rule {id}", "enabled": True, "condition": condition, **more}
    return Rule.parse({**doc, "actions": [{"type": t, "config": c} for t, c in actions]})


def leaf(field: str, operator: str, value=None) -> dict:
    return {"field": field, "operator": operator, "value": value}


# ---- conditions ----

ERROR = leaf("level", "eq", "ERROR")
SLOW = leaf("duration_ms", "gt", 1000)
BAD_PATTERN = leaf("message", "matches", "(?=x)")

# name -> (condition, SQL over logs)
CONDITIONS = {
    "eq": (leaf("level", "eq", "ERROR"), "level = 'ERROR'"),
    "ne": (leaf("service", "ne", "api-gateway"), "service <> 'api-gateway'"),
    "gt": (leaf("duration_ms", "gt", 1000), "duration_ms > 1000"),
    # a numeric text against a JSON number
    "lt": (leaf("k", "lt", "25"), "k < 25"),
    "ge": (leaf("fields.k", "ge", 90.5), "k >= 90.5"),
    "le": (leaf("line_number", "le", 20), "line_number <= 20"),
    "contains": (leaf("message", "contains", "timeout"), "contains(message, 'timeout')"),
    # numbers are compared as text here
    "starts_with": (leaf("k", "starts_with", "7"), "starts_with(cast(k as varchar), '7')"),
    "ends_with": (leaf("message", "ends_with", "ms"), "ends_with(message, 'ms')"),
    "matches": (
        leaf("message", "matches", r"^(?P<verb>GET|POST)\s+\S+\s+(2\d\d|404)\b"),
        r"regexp_matches(message, '^(?P<verb>GET|POST)\s+\S+\s+(2\d\d|404)\b')",
    ),
    "in": (leaf("k", "in", [1, "2", 3.0, "x"]), "k in (1, 2, 3)"),
    "not_in": (leaf("service", "not_in", ["api-gateway", "user-service"]), "service not in ('api-gateway', 'user-service')"),
    "exists": (leaf("k", "exists"), "json_exists(props, '$.k')"),
    "not_exists": (leaf("fields.k.deeper", "not_exists"), "not json_exists(props, '$.k.deeper')"),
    "all": ({"all": [ERROR, leaf("k", "gt", 50), leaf("message", "contains", "10.0.")]}, "level = 'ERROR' and k > 50 and contains(message, '10.0.')"),
    # the sound branch comes first, so the broken one is only met where it fails
    "any": ({"any": [ERROR, SLOW, BAD_PATTERN]}, "level = 'ERROR' or duration_ms > 1000"),
    # a missing field is false inside, so its negation is true
    "not": ({"all": [{"not": leaf("nowhere", "eq", "x")}, {"not": ERROR}]}, "level <> 'ERROR'"),
}


def _condition(name: str, condition: dict, sql: str) -> None:
    @query(f"cond_{name}", O.logs(f"select id, level, service, message from logs where {sql}"))
    def job(spark, folder):
        return filter_where(views.logs(spark, folder), condition).select("id", "level", "service", "message")


for _name, (_condition_doc, _sql) in CONDITIONS.items():
    _condition(_name, _condition_doc, _sql)


@query("cond_custom", O.logs("select id, message from logs where strlen(message) % 7 = 3"))
def cond_custom(spark, folder):
    operators = {"length_mod_7": lambda value, expected: F.octet_length(value.text) % 7 == expected}
    return filter_where(views.logs(spark, folder), leaf("message", "length_mod_7", 3), operators=operators).select("id", "message")


# ---- actions ----

HASH = "('0x' || substr(md5(concat(cast(id as varchar), ':', '{rule}', ':0')), 1, 8))::bigint / 4294967296.0"


def run(spark, folder, rules, options: Options = Options(), drop: bool = True):
    return apply_rules(views.logs(spark, folder), rules, options, drop=drop)


@query("act_keep", O.logs("select id, level from logs where level = 'ERROR' or service <> 'api-gateway'"))
def act_keep(spark, folder):
    return run(spark, folder, [rule("a", ERROR, ("keep", {})), rule("b", leaf("service", "eq", "api-gateway"), ("drop", {}))]).select("id", "level")


@query("act_drop", O.logs("select id, level from logs where level not in ('DEBUG', 'INFO')"))
def act_drop(spark, folder):
    return run(spark, folder, [rule("a", leaf("level", "in", ["DEBUG", "INFO"]), ("drop", {}))]).select("id", "level")


@query("act_sample", O.logs(f"select id, level from logs where level <> 'INFO' or {HASH.format(rule='s')} < 0.2"))
def act_sample(spark, folder):
    return run(spark, folder, [rule("s", leaf("level", "eq", "INFO"), ("sample", {"rate": 0.2}))]).select("id", "level")


@query(
    "act_mask",
    O.logs(
        r"""select id, case when contains(message, 'password=')
        then concat(regexp_replace(message, 'password=\w+', ''), repeat('#', strlen(regexp_extract(message, 'password=\w+'))))
        else message end message, repeat('*', strlen(trace_id)) trace_id from logs"""
    ),
)
def act_mask(spark, folder):
    rules = [
        rule("a", leaf("message", "contains", "password="), ("mask", {"field": "message", "pattern": r"password=\w+", "character": "#"})),
        rule("b", leaf("trace_id", "exists"), ("mask", {"field": "trace_id"})),
    ]
    return run(spark, folder, rules).select("id", "message", "trace_id")


@query("act_truncate", O.logs("select id, case when strlen(message) > 25 then concat(substr(message, 1, 25), '~') else message end message from logs"))
def act_truncate(spark, folder):
    return run(spark, folder, [rule("a", leaf("message", "exists"), ("truncate", {"field": "message", "max_length": 25, "suffix": "~"}))]).select(
        "id", "message"
    )


@query(
    "act_extract",
    O.logs(r"select id, case when regexp_matches(message, '(\d+)ms$') then regexp_extract(message, '(\d+)ms$', 1) end took from logs"),
)
def act_extract(spark, folder):
    config = {"source_field": "message", "target_field": "took", "pattern": r"(\d+)ms$"}
    return run(spark, folder, [rule("a", leaf("message", "exists"), ("extract", config))]).select("id", json_field("took").alias("took"))


@query("act_rename", O.logs("""select id, concat('{"stats":{"k":', cast(k as varchar), '},"severity":"', level, '"}') fields, cast(null as varchar) level from logs"""))
def act_rename(spark, folder):
    rules = [
        rule("a", leaf("k", "exists"), ("rename", {"from": "k", "to": "stats.k"})),
        rule("b", leaf("level", "exists"), ("rename", {"from": "level", "to": "severity"})),
    ]
    return run(spark, folder, rules).select("id", F.to_json("fields").alias("fields"), "level")


@query("act_remove", O.logs("select id, case when k > 50 then '{}' else concat('{\"k\":', cast(k as varchar), '}') end fields, case when k > 50 then null else path end path from logs"))
def act_remove(spark, folder):
    return run(spark, folder, [rule("a", leaf("k", "gt", 50), ("remove", {"field": "path", "fields": ["k", "nowhere"]}))]).select(
        "id", F.to_json("fields").alias("fields"), "path"
    )


@query(
    "act_set",
    O.logs(
        """select id, concat('{"k":', cast(k as varchar), case when level = 'ERROR' then ',"ops":{"page":{"on":true}}' else '' end, '}') fields,
        case when level = 'ERROR' then 'core' else component end component from logs"""
    ),
)
def act_set(spark, folder):
    rules = [rule("a", ERROR, ("set", {"field": "ops.page.on", "value": True}), ("set", {"field": "component", "value": "core"}))]
    return run(spark, folder, rules).select("id", F.to_json("fields").alias("fields"), "component")


@query(
    "act_mark",
    O.logs("select id, case when contains(message, 'slow query') then 'slow' when level = 'ERROR' then 'failed' end tag from logs"),
)
def act_mark(spark, folder):
    rules = [
        rule("a", ERROR, ("mark", {"value": "failed", "reason": "level"})),
        rule("b", leaf("message", "contains", "slow query"), ("mark", {"value": "slow"})),
    ]
    return run(spark, folder, rules).select("id", json_field("_tags").alias("tag"))


@query(
    "act_chain",
    O.logs(
        r"""select id, case when level = 'WARN' then concat('rows=', regexp_replace(regexp_extract(message, 'rows=(\d+)', 1), '^(\d)\d+$', '\1+')) else message end message,
        case when level = 'WARN' then true else false end done from logs where level <> 'DEBUG'"""
    ),
)
def act_chain(spark, folder):
    steps = (
        ("extract", {"source_field": "message", "target_field": "tmp.rows", "pattern": r"rows=(\d+)"}),
        ("truncate", {"field": "tmp.rows", "max_length": 1, "suffix": "+"}),
        ("set", {"field": "k.not_a_map", "value": 1}),  # fails, the chain goes on
        ("extract", {"source_field": "tmp.rows", "target_field": "tmp.rows", "pattern": "(.*)"}),
        ("set", {"field": "message", "value": "rows="}),
        ("set", {"field": "done", "value": True}),
    )
    rules = [rule("a", leaf("level", "eq", "WARN"), *steps), rule("b", leaf("level", "eq", "DEBUG"), ("drop", {}), ("keep", {}))]
    out = run(spark, folder, rules)
    return out.select(
        "id",
        F.concat("message", F.coalesce(F.try_variant_get(F.try_element_at("fields", F.lit("tmp")), "$.rows", "string"), F.lit(""))).alias("message"),
        F.coalesce(json_field("done") == "true", F.lit(False)).alias("done"),
    )


@query("act_custom", O.logs("select id, case when level = 'ERROR' then upper(message) else message end message from logs"))
def act_custom(spark, folder):
    def shout(ctx, action):
        name = action.text("field")
        value = ctx.entry.value(name)
        return Effect(writes=[(value.present, w) for w in ctx.entry.put(name, F.upper(value.text).cast("variant"))])

    return run(spark, folder, [rule("a", ERROR, ("shout", {"field": "message"}))], Options(handlers={"shout": shout})).select("id", "message")


# ---- rule sets ----

TEN_RULES = [
    rule("01-noise", {"all": [leaf("level", "eq", "DEBUG"), leaf("service", "eq", "content-service")]}, ("drop", {})),
    rule("02-errors", {"all": [ERROR, leaf("message", "contains", "timeout")]}, ("mark", {"value": "timeout"})),
    rule("03-secrets", leaf("message", "contains", "password="), ("mask", {"field": "message", "pattern": r"password=\w+"})),
    rule("04-sample", {"all": [leaf("level", "eq", "INFO"), leaf("message", "starts_with", "GET ")]}, ("sample", {"rate": 0.5})),
    rule("05-slow", SLOW, ("set", {"field": "slow", "value": True})),
    rule("06-took", leaf("message", "matches", r"\d+ms$"), ("extract", {"source_field": "message", "target_field": "took", "pattern": r"(\d+)ms$"})),
    rule("07-critical", leaf("service", "in", ["payment-service", "auth-service"]), ("set", {"field": "critical", "value": "yes"})),
    rule("08-k", leaf("k", "ge", 95), ("rename", {"from": "k", "to": "top_k"})),
    rule("09-not-found", {"any": [leaf("message", "contains", " 404 "), leaf("message", "contains", " 500 ")]}, ("keep", {})),
    rule("10-long", leaf("line_number", "gt", 30), ("truncate", {"field": "message", "max_length": 30})),
]

_MASKED = r"case when contains(message, 'password=') then concat(regexp_replace(message, 'password=\w+', ''), repeat('*', strlen(regexp_extract(message, 'password=\w+')))) else message end"
_STOPPED = "(contains(message, ' 404 ') or contains(message, ' 500 '))"
# the last matching rule decides: any match after the sample keeps the row
_LATER = r"""(duration_ms > 1000 or regexp_matches(message, '\d+ms$') or service in ('payment-service', 'auth-service') or k >= 95
 or line_number > 30)"""
TEN_RULES_SQL = O.logs(
    rf"""select id, case when line_number > 30 and not {_STOPPED} and strlen({_MASKED}) > 30 then concat(substr({_MASKED}, 1, 30), '...') else {_MASKED} end message,
    case when level = 'ERROR' and contains(message, 'timeout') then 'timeout' end tag,
    case when duration_ms > 1000 then 'true' end slow,
    case when regexp_matches(message, '\d+ms$') then regexp_extract(message, '(\d+)ms$', 1) end took,
    case when service in ('payment-service', 'auth-service') then 'yes' end critical,
    case when k >= 95 then k end top_k
    from logs where not (level = 'DEBUG' and service = 'content-service')
    and (not (level = 'INFO' and starts_with(message, 'GET ')) or {_LATER} or {HASH.format(rule='04-sample')} < 0.5)"""
)


@query("rules_apply", TEN_RULES_SQL)
def rules_apply(spark, folder):
    out = run(spark, folder, TEN_RULES)
    return out.select(
        "id",
        "message",
        json_field("_tags").alias("tag"),
        json_field("slow").alias("slow"),
        json_field("took").alias("took"),
        json_field("critical").alias("critical"),
        json_field("top_k").cast("bigint").alias("top_k"),
    )


FLOW = [
    rule("a-sample", leaf("level", "eq", "INFO"), ("sample", {"rate": 0.3})),
    rule("b-drop", leaf("service", "eq", "api-gateway"), ("drop", {})),
    rule("c-mark", leaf("k", "gt", 80), ("mark", {"value": "x"})),
]


@query(
    "rules_terminate",
    O.logs(
        f"""select id,
        case when service = 'api-gateway' then false when k > 80 then true when level = 'INFO' then {HASH.format(rule='a-sample')} < 0.3 else true end keep,
        case when service = 'api-gateway' then (case when level = 'INFO' then {HASH.format(rule='a-sample')} < 0.3 else true end) = false
          when k > 80 then true when level = 'INFO' then {HASH.format(rule='a-sample')} < 0.3 else true end keep_compat from logs"""
    ),
)
def rules_terminate(spark, folder):
    plain = run(spark, folder, FLOW, drop=False).withColumnRenamed(R.KEEP, "keep")
    return apply_rules(plain, FLOW, Options(compat=True), drop=False).select("id", "keep", F.col(R.KEEP).alias("keep_compat"))


@query(
    "rules_audit",
    O.logs(
        f"""select id, 'a-sample' rule_id, {HASH.format(rule='a-sample')} < 0.3 should_keep, false "terminate", 'sample' action from logs where level = 'INFO'
        union all select id, 'b-drop', false, true, 'drop' from logs where service = 'api-gateway'
        union all select id, 'c-mark', true, false, 'mark' from logs where k > 80 and service <> 'api-gateway'"""
    ),
)
def rules_audit(spark, folder):
    audited = run(spark, folder, FLOW, Options(audit=True), drop=False)
    return R.audit_rows(audited, "id").select("id", "rule_id", "should_keep", "terminate", F.get("actions", F.lit(0))["type"].alias("action"))


@query(
    "rules_stats",
    O.logs(
        """, m as (select cast(level = 'INFO' as int) a, cast(service = 'api-gateway' as int) b, cast(k > 80 and service <> 'api-gateway' as int) c from logs)
        select cast(sum(a + b + c + 1 - b) as bigint) total_evaluations, cast(sum(a + b + c) as bigint) matched_evaluations,
        cast(sum(a + b + c) as bigint) actions_executed, cast(0 as bigint) failed_actions from m"""
    ),
)
def rules_stats(spark, folder):
    return R.rule_stats(run(spark, folder, FLOW, Options(counters=True), drop=False))


@query("rules_single", O.logs("select id, level = 'ERROR' matched, case when level = 'ERROR' then 'E' else level end level from logs"))
def rules_single(spark, folder):
    return R.evaluate_single(views.logs(spark, folder), rule("a", ERROR, ("set", {"field": "level", "value": "E"}))).select("id", "matched", "level")


@query(
    "rules_scoped",
    O.logs(
        """select id, service, case service when 'auth-service' then 'auth' when 'user-service' then 'user' end owner from logs
        where not (service = 'auth-service' and level = 'DEBUG') and not (duration_ms < 100)"""
    ),
)
def rules_scoped(spark, folder):
    scoped = R.scoped(
        [
            Rule.parse(rule("9", leaf("duration_ms", "lt", 100), ("drop", {})).to_doc(), scope="defaults/processor"),
            Rule.parse(rule("1", leaf("level", "eq", "DEBUG"), ("drop", {})).to_doc(), scope="clients/auth-service.prod/processor"),
            Rule.parse(rule("2", leaf("level", "exists"), ("set", {"field": "owner", "value": "auth"})).to_doc(), scope="clients/auth-service.prod/processor"),
            Rule.parse(rule("2", leaf("level", "exists"), ("set", {"field": "owner", "value": "user"})).to_doc(), scope="clients/user-service.prod/processor"),
            Rule.parse(rule("3", leaf("level", "exists"), ("drop", {})).to_doc(), scope="clients/user-service.test/processor"),
        ]
    )
    logs = views.logs(spark, folder).withColumn("environment", F.lit("prod"))
    return apply_rules(logs, scoped).select("id", "service", json_field("owner").alias("owner"))


@query("rules_dry_run", O.logs(
    """select 'a-sample' rule_id, count(*) filter (level = 'INFO') matched, cast(0 as bigint) would_drop, count(*) tested from logs
    union all select 'b-drop', count(*) filter (service = 'api-gateway'), count(*) filter (service = 'api-gateway'), count(*) from logs
    union all select 'c-mark', count(*) filter (k > 80), 0, count(*) from logs"""
))
def rules_dry_run(spark, folder):
    return R.dry_run(views.logs(spark, folder), FLOW).drop("enabled")


@query("sdk_decision", O.logs("select id, service <> 'api-gateway' should_log, case when level = 'ERROR' and service <> 'api-gateway' then 0.25 else 1.0 end::double sampling from logs"))
def sdk_decision(spark, folder):
    rules = [
        rule("a", leaf("service", "eq", "api-gateway"), ("drop", {})),
        rule("b", ERROR, ("mark", {"field": "_marks.sampling_rate", "value": 0.25})),
    ]
    return R.sdk_decision(views.logs(spark, folder), rules).select("id", "should_log", "sampling")


# ---- stores: rule documents derived from orders, one per order ----

_BODY = """case when o_orderkey % 11 = 0 then '{broken' when o_orderkey % 13 = 0 then '[1]' else
 concat('{"id":"r', cast(o_orderkey as {text}), '","name":"', o_orderpriority, '","enabled":', case when o_orderkey % 3 = 0 then 'false' else 'true' end,
 ',"priority":', cast(o_custkey % 10 as {text}), '}') end"""


def _rule_store(spark, folder):
    orders = views.table(spark, folder, "orders")
    return orders.select(F.concat(F.lit("r"), "o_orderkey").alias("id"), F.lit("defaults/processor").alias("scope"), F.expr(_BODY.replace("{text}", "string")).alias("body"))


@query(
    "rules_load",
    """select concat('r', cast(o_orderkey as varchar)) id, o_orderpriority as name, o_orderkey % 3 <> 0 enabled, cast(o_custkey % 10 as bigint) priority
    from orders where o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0""",
)
def rules_load(spark, folder):
    return stores.documents(_rule_store(spark, folder)).select("id", "name", "enabled", "priority")


@query(
    "filter_configs_active",
    """select concat('r', cast(o_orderkey as varchar)) id, cast(o_custkey % 10 as bigint) priority,
    row_number() over (partition by o_custkey % 10 order by concat('r', cast(o_orderkey as varchar))) place
    from orders where o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 and o_orderkey % 3 <> 0""",
)
def filter_configs_active(spark, folder):
    ordered = stores.active_documents(_rule_store(spark, folder))
    place = F.row_number().over(Window.partitionBy("priority").orderBy("id"))
    return ordered.select("id", "priority").withColumn("place", place.cast("bigint"))


@query(
    "rules_reload",
    """select concat('c', cast(o_custkey as varchar)) id, arg_max(o_orderkey, o_orderkey) last_order from orders
    group by o_custkey having arg_max(o_orderkey % 4, o_orderkey) <> 0""",
)
def rules_reload(spark, folder):
    # every order is a change of its customer's rule: a delete when divisible by four, else a put
    orders = views.table(spark, folder, "orders")
    changes = orders.select(
        F.concat(F.lit("c"), "o_custkey").alias("id"),
        F.lit("defaults/processor").alias("scope"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 4 == 0, "delete").otherwise("put").alias("op"),
        F.format_string('{"id":"c%d","name":"n","order":%d}', "o_custkey", "o_orderkey").alias("body"),
    )
    live = stores.latest(changes)
    return live.select("id", F.get_json_object("body", "$.order").cast("bigint").alias("last_order"))


# ---- versions: each order is a version of its customer's rule ----


def _versions(spark, folder):
    orders = views.table(spark, folder, "orders")
    return orders.select(
        F.concat(F.lit("v"), "o_orderkey").alias("id"),
        F.concat(F.lit("c"), "o_custkey").alias("rule_id"),
        F.col("o_orderkey").cast("bigint").alias("version"),
        F.concat(F.lit('{"order":'), F.col("o_orderkey").cast("string"), F.lit("}")).alias("content"),
        F.lit("ops").alias("author"),
        F.lit("").alias("comment"),
        F.timestamp_seconds(F.col("o_orderkey").cast("bigint") * 60).alias("created_at"),
    )


@query(
    "rule_history",
    """select concat('c', cast(o_custkey as varchar)) rule_id, cast(o_orderkey as bigint) version, cast(o_orderkey as bigint) * 60 valid_from,
    cast(lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as bigint) * 60 valid_to from orders""",
)
def rule_history(spark, folder):
    out = V.history(_versions(spark, folder))
    return out.select("rule_id", "version", F.unix_seconds("valid_from").alias("valid_from"), F.unix_seconds("valid_to").alias("valid_to"))


@query(
    "rule_rollback",
    """select concat('c', cast(o_custkey as varchar)) rule_id, cast(max(o_orderkey) + 1 as bigint) version,
    concat('{"order":', cast(min(o_orderkey) as varchar), '}') content from orders group by o_custkey""",
)
def rule_rollback(spark, folder):
    # every rule goes back to its first version
    versions = _versions(spark, folder)
    first = versions.groupBy("rule_id").agg(F.min("version").alias("version"))
    again = V.rollback(versions, first, F.lit("2024-01-31").cast("timestamp"))
    return V.current(versions.unionByName(again)).select("rule_id", "version", "content")


@query(
    "rules_indexed",
    O.logs(
        """select id, message from logs l where (level = 'ERROR' and exists (select 1 from nation n where contains(l.message, concat(' from 10.0.', cast(10 * n_nationkey as varchar), '.'))))
        or not exists (select 1 from customer c where l.user_id = concat('u_', cast(c_custkey as varchar)) and l.k > 3 * c_nationkey)"""
    ),
)
def rules_indexed(spark, folder):
    """A rule for each customer, which drops rows of one user, and one for each nation, which keeps some errors whoever's they are."""

    def body(action: str, *leaves):
        fields = [F.struct(F.lit(f).alias("field"), F.lit(o).alias("operator"), v.alias("value")) for f, o, v in leaves]
        texts = F.concat(F.lit('{"all":['), F.concat_ws(",", *[F.to_json(x) for x in fields]), F.lit("]}"))
        head = F.concat(F.lit('{"name":"r","enabled":true,"id":"'), F.col("id"), F.lit(f'","actions":[{{"type":"{action}"}}],"condition":'))
        return F.concat(head, texts, F.lit("}")).alias("body")

    customers = views.table(spark, folder, "customer").withColumn("id", F.concat(F.lit("drop-"), "c_custkey"))
    drops = customers.select("id", F.lit("").alias("scope"), body("drop", ("user_id", "eq", F.concat(F.lit("u_"), "c_custkey")), ("k", "gt", 3 * F.col("c_nationkey"))))
    nations = views.table(spark, folder, "nation").withColumn("id", F.concat(F.lit("a-keep-"), "n_nationkey"))
    part = F.concat(F.lit(" from 10.0."), (10 * F.col("n_nationkey")).cast("string"), F.lit("."))
    keeps = nations.select("id", F.lit("").alias("scope"), body("keep", ("message", "contains", part), ("level", "eq", F.lit("ERROR"))))
    logs = views.logs(spark, folder)
    index = X.build_table(stores.documents(drops.unionByName(keeps)), logs)
    return X.apply_index(logs, index).select("id", "message")


@query(
    "rules_to_tree",
    """select concat('o', cast(l_orderkey as varchar)) rule_id, count(*) conditions,
    case when count(*) = 1 then max(doc) else concat('{"all":[', string_agg(doc, ',' order by l_linenumber, doc), ']}') end condition from (
      select l_orderkey, l_linenumber, concat('{"field":"', l_returnflag, '","operator":"eq","value":"', cast(l_partkey as varchar), '"}') doc from lineitem)
    group by l_orderkey""",
)
def rules_to_tree(spark, folder):
    items = views.table(spark, folder, "lineitem").select(
        F.concat(F.lit("o"), "l_orderkey").alias("rule_id"),
        F.col("l_linenumber").alias("position"),
        F.col("l_returnflag").alias("field"),
        F.lit("eq").alias("operator"),
        F.col("l_partkey").cast("string").alias("value"),
    )
    return V.to_tree(items).select("rule_id", F.col("conditions").cast("bigint").alias("conditions"), "condition")


@query(
    "rules_with_children",
    """select concat('o', cast(o_orderkey as varchar)) id, o_orderpriority service, coalesce(c.n, 0) conditions, coalesce(c.parts, '') parts, coalesce(a.n, 0) actions
    from orders left join (select l_orderkey, count(*) n, string_agg(cast(l_partkey as varchar), ',' order by l_linenumber, cast(l_partkey as varchar)) parts from lineitem group by l_orderkey) c on c.l_orderkey = o_orderkey
    left join (select l_orderkey, count(*) n from lineitem where l_returnflag = 'R' group by l_orderkey) a on a.l_orderkey = o_orderkey
    where o_orderpriority = '1-URGENT'""",
)
def rules_with_children(spark, folder):
    name = F.concat(F.lit("o"), "l_orderkey").alias("rule_id")
    rules = views.table(spark, folder, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("service"))
    items = views.table(spark, folder, "lineitem")
    conditions = items.select(name, F.col("l_linenumber").alias("position"), F.col("l_partkey").cast("string").alias("value"))
    actions = items.filter("l_returnflag = 'R'").select(name, F.col("l_linenumber").alias("position"))
    out = Q.rules_with_children(rules, conditions, actions, service="1-URGENT")
    return out.select(
        "id", "service", F.when(F.col("conditions").isNull(), 0).otherwise(F.size("conditions")).cast("bigint").alias("conditions"),
        F.coalesce(F.array_join("conditions.value", ","), F.lit("")).alias("parts"),
        F.when(F.col("actions").isNull(), 0).otherwise(F.size("actions")).cast("bigint").alias("actions"),
    )


@query(
    "rules_as_of",
    O.logs(
        """select id, case when "timestamp" < timestamp '2024-01-10' then 'one' when "timestamp" < timestamp '2024-01-20 12:00:00' then 'two' else 'three' end edition
        from logs where not ("timestamp" >= timestamp '2024-01-10' and "timestamp" < timestamp '2024-01-20 12:00:00' and level = 'DEBUG')"""
    ),
)
def rules_as_of(spark, folder):
    def edition(word: str) -> Rule:
        return rule("mark", leaf("level", "exists"), ("mark", {"field": "edition", "value": word}))

    quiet = rule("quiet", leaf("level", "eq", "DEBUG"), ("drop", {}))
    table = [
        ("mark", 1, edition("one"), "2000-01-01 00:00:00"),
        ("mark", 2, edition("two"), "2024-01-10 00:00:00"),
        ("mark", 3, edition("three"), "2024-01-20 12:00:00"),
        ("quiet", 1, quiet, "2024-01-10 00:00:00"),
        ("quiet", 2, replace(quiet, enabled=False), "2024-01-20 12:00:00"),
    ]
    rows = [(f"{r}-{v}", r, v, json.dumps(body.to_doc()), "me", "", datetime.datetime.fromisoformat(when)) for r, v, body, when in table]
    versions = V.in_force(spark.createDataFrame(rows, RULE_VERSION))
    return V.apply_as_of(views.logs(spark, folder), versions).select("id", json_field("edition").alias("edition"))


@query(
    "rules_as_of_versions",
    O.logs(
        """select id, message from (select l.id, l.message, l.k, arg_max({'limit': o_orderkey % 100, 'on': o_orderkey % 7 <> 0},
          {'at': timestamp '2024-01-01' + to_seconds(o_orderkey * 7919 % 2592000), 'v': o_orderkey}) filter (timestamp '2024-01-01' + to_seconds(o_orderkey * 7919 % 2592000) <= l."timestamp") v
          from logs l left join orders o on l.user_id = concat('u_', cast(o.o_custkey as varchar)) group by l.id, l.message, l.k)
        where not coalesce(v['on'] and k > v['limit'], false)"""
    ),
)
def rules_as_of_versions(spark, folder):
    """A version for each order: from some moment on, rows of the customer above a limit are dropped; one in seven versions switches the rule off."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    head = F.concat(F.lit('{"name":"r","id":"r'), customer, F.lit('","actions":[{"type":"drop"}],"enabled":'), (key % 7 != 0).cast("string"))
    leaves = F.concat(F.lit(',"condition":{"all":[{"field":"user_id","operator":"eq","value":"u_'), customer, F.lit('"},{"field":"k","operator":"gt","value":'), (key % 100).cast("string"), F.lit("}]}}"))
    versions = views.table(spark, folder, "orders").select(
        F.concat(F.lit("r"), customer).alias("rule_id"), key.cast("bigint").alias("version"), F.concat(head, leaves).alias("content"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + key * 7919 % 2592000).alias("created_at"),
    )
    logs = views.logs(spark, folder)
    return V.apply_versions(logs, V.index_versions(versions, logs)).select("id", "message")
