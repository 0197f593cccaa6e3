"""The log views as DuckDB SQL, for the check queries."""

LOGS = """logs as (
select event_id id, ts "timestamp",
 case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' when 'signup' then 'DEBUG' else 'INFO' end "level",
 case user_id % 6 when 0 then 'api-gateway' when 1 then 'user-service' when 2 then 'order-service' when 3 then 'payment-service' when 4 then 'auth-service' else 'content-service' end service,
 case when user_id % 2 = 0 then 'sdk' else 'processor' end component,
 case event_type
  when 'error' then concat('upstream timeout after ', cast(event_id % 5000 as varchar), ' from 10.0.', cast(user_id % 256 as varchar), '.', cast(event_id % 256 as varchar))
  when 'view' then concat('GET /api/v1/items/', cast(event_id % 50 as varchar), ' 200 ', cast(event_id % 300 as varchar), 'ms')
  when 'click' then concat('POST /api/v1/clicks ', case when event_id % 7 = 0 then '404' else '201' end, ' ', cast(event_id % 90 as varchar), 'ms')
  when 'purchase' then concat('slow query table=orders duration=', cast(900 + event_id % 200 as varchar), ' rows=', cast(user_id as varchar))
  else concat('login ok user_id=u_', cast(user_id as varchar), ' password=p', cast(event_id as varchar)) end message,
 concat('pkg/', event_type, '.go') path, concat('On', upper(event_type)) "function", cast(10 * (1 + user_id % 4) as int) line_number,
 substr(md5(cast(event_id // 5 as varchar)),1,16) trace_id, concat('u_', cast(user_id as varchar)) user_id, value * 10 duration_ms,
 props, event_type, cast(json_extract(props, '$.k') as bigint) k
 from events)"""

RAW_LINES = """raw_lines as (
select id, "timestamp" logged_at, case id % 6
 when 0 then concat('{"timestamp":"', strftime("timestamp",'%Y-%m-%dT%H:%M:%SZ'), '","level":"', "level", '","message":"', message, '","service":"', service, '","trace_id":"', trace_id, '","user_id":"', user_id, '"}')
 when 1 then concat('timestamp=', strftime("timestamp",'%Y-%m-%dT%H:%M:%SZ'), ' level=', lower("level"), ' service=', service, ' trace_id=', trace_id, ' msg=', "function", ' line=', cast(line_number as varchar))
 when 2 then concat('<', cast(24 + id % 8 as varchar), '>', strftime("timestamp",'%b %-d %H:%M:%S'), ' host', cast(id % 9 as varchar), ' ', service, '[', cast(1000 + id % 500 as varchar), ']: ', "function", ' done')
 when 3 then concat('10.1.', cast(id % 200 as varchar), '.7 - frank [', strftime("timestamp",'%d/%b/%Y:%H:%M:%S +0000'), '] "GET /api/v1/items/', cast(id % 50 as varchar), ' HTTP/1.1" ', case id % 4 when 0 then '200' when 1 then '404' when 2 then '503' else '301' end, ' ', cast(100 + id % 900 as varchar))
 when 4 then concat('10.2.', cast(id % 200 as varchar), '.9 - - [', strftime("timestamp",'%d/%b/%Y:%H:%M:%S +0000'), '] "POST /api/v1/orders HTTP/1.1" ', case id % 3 when 0 then '201' when 1 then '500' else '400' end, ' ', cast(100 + id % 900 as varchar), ' "https://shop.example.com/" "Mozilla/5.0"')
 else concat('Connection from 192.168.', cast(id % 250 as varchar), '.4 was slow, ', "function", ' failed and see https://status.example.com/', cast(id as varchar), ' or mail ops@example.com') end raw
 from logs)"""

TIME = "'%Y-%m-%d %H:%M:%S.%f'"

# Token list, masked key and template of a message column, as expressions.
TOKENS = r"list_filter(list_transform(string_split_regex({m}, '[\s,;:=\[\]{{}}()]+'), lambda t: trim(t)), lambda t: t <> '')"
VARIABLE = (
    r"regexp_matches({t}, '^\d+$|^[a-f0-9]{{8}}-[a-f0-9]{{4}}-[a-f0-9]{{4}}-[a-f0-9]{{4}}-[a-f0-9]{{12}}$"
    r"|^\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}$|^\d{{4}}-\d{{2}}-\d{{2}}|^[a-f0-9]{{8,}}$')"
)


def tokens(m: str = "message") -> str:
    return TOKENS.format(m=m)


def masked(mark: str, m: str = "message") -> str:
    return f"list_transform({tokens(m)}, lambda t: case when {VARIABLE.format(t='t')} then '{mark}' else t end)"


def key(m: str = "message") -> str:
    return f"array_to_string(list_slice({masked('*', m)}, 1, 4), ' ')"


def template(m: str = "message") -> str:
    return f"array_to_string({masked('<*>', m)}, ' ')"


# one row per group of messages, its template and count
KEYED = f"keyed as (select *, {key()} as grp from logs)"
GROUPS = f"""grouped as (select grp, count(*) n, arg_min(message, ("timestamp", id)) first_message from keyed group by grp),
patterns as (select {template('first_message')} pattern, cast(sum(n) as bigint) frequency from grouped group by 1)"""


def logs(sql: str, *more: str) -> str:
    return "with " + ", ".join([LOGS, *more]) + " " + sql


def lines(sql: str, *more: str) -> str:
    return "with " + ", ".join([LOGS, RAW_LINES, *more]) + " " + sql


def mined(sql: str, *more: str) -> str:
    return logs(sql, KEYED, GROUPS, *more)
