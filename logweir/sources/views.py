"""The given tables, and the log views that are derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweir.schemas import DYNAMIC


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# column name -> SQL over events
LOG_COLUMNS = {
    "id": "event_id",
    "timestamp": "ts",
    "level": "case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' when 'signup' then 'DEBUG' else 'INFO' end",
    "service": "case user_id % 6 when 0 then 'api-gateway' when 1 then 'user-service' when 2 then 'order-service'"
    " when 3 then 'payment-service' when 4 then 'auth-service' else 'content-service' end",
    "component": "case when user_id % 2 = 0 then 'sdk' else 'processor' end",
    "message": """case event_type
      when 'error' then concat('upstream timeout after ', cast(event_id % 5000 as string), ' from 10.0.', cast(user_id % 256 as string), '.', cast(event_id % 256 as string))
      when 'view' then concat('GET /api/v1/items/', cast(event_id % 50 as string), ' 200 ', cast(event_id % 300 as string), 'ms')
      when 'click' then concat('POST /api/v1/clicks ', case when event_id % 7 = 0 then '404' else '201' end, ' ', cast(event_id % 90 as string), 'ms')
      when 'purchase' then concat('slow query table=orders duration=', cast(900 + event_id % 200 as string), ' rows=', cast(user_id as string))
      else concat('login ok user_id=u_', cast(user_id as string), ' password=p', cast(event_id as string)) end""",
    "path": "concat('pkg/', event_type, '.go')",
    "function": "concat('On', upper(event_type))",
    "line_number": "cast(10 * (1 + user_id % 4) as int)",
    "trace_id": "substr(md5(cast(event_id div 5 as string)), 1, 16)",
    "user_id": "concat('u_', cast(user_id as string))",
    "duration_ms": "value * 10",
    "fields_json": "props",
    "event_type": "event_type",
}

RAW_LINE = """case id % 6
  when 0 then concat('{"timestamp":"', date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"), '","level":"', level, '","message":"', message, '","service":"', service, '","trace_id":"', trace_id, '","user_id":"', user_id, '"}')
  when 1 then concat('timestamp=', date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"), ' level=', lower(level), ' service=', service, ' trace_id=', trace_id, ' msg=', function, ' line=', cast(line_number as string))
  when 2 then concat('<', cast(24 + id % 8 as string), '>', date_format(timestamp, 'MMM d HH:mm:ss'), ' host', cast(id % 9 as string), ' ', service, '[', cast(1000 + id % 500 as string), ']: ', function, ' done')
  when 3 then concat('10.1.', cast(id % 200 as string), '.7 - frank [', date_format(timestamp, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] "GET /api/v1/items/', cast(id % 50 as string), ' HTTP/1.1" ', case id % 4 when 0 then '200' when 1 then '404' when 2 then '503' else '301' end, ' ', cast(100 + id % 900 as string))
  when 4 then concat('10.2.', cast(id % 200 as string), '.9 - - [', date_format(timestamp, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] "POST /api/v1/orders HTTP/1.1" ', case id % 3 when 0 then '201' when 1 then '500' else '400' end, ' ', cast(100 + id % 900 as string), ' "https://shop.example.com/" "Mozilla/5.0"')
  else concat('Connection from 192.168.', cast(id % 250 as string), '.4 was slow, ', function, ' failed and see https://status.example.com/', cast(id as string), ' or mail ops@example.com') end"""


def logs_from_events(events: DataFrame) -> DataFrame:
    out = events.selectExpr(*[f"{sql} as `{name}`" for name, sql in LOG_COLUMNS.items()])
    return out.withColumn("fields", F.from_json("fields_json", DYNAMIC))


def logs(spark: SparkSession, folder: str) -> DataFrame:
    return logs_from_events(table(spark, folder, "events"))


def raw_lines_from_logs(df: DataFrame) -> DataFrame:
    return df.selectExpr("id", f"{RAW_LINE} as raw", "timestamp as logged_at")


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    return raw_lines_from_logs(logs(spark, folder))
