"""Table schemas."""

from pyspark.sql import types as T

DYNAMIC = T.MapType(T.StringType(), T.VariantType())

ENTITIES = T.ArrayType(
    T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("value", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in cols])


LOGS = _struct(
    ("id", T.LongType()),
    ("service", T.StringType()),
    ("component", T.StringType()),
    ("timestamp", T.TimestampType()),
    ("level", T.StringType()),
    ("message", T.StringType()),
    ("path", T.StringType()),
    ("function", T.StringType()),
    ("line_number", T.IntegerType()),
    ("trace_id", T.StringType()),
    ("user_id", T.StringType()),
    ("fields", DYNAMIC),
    ("created_at", T.TimestampType()),
)

# A batch of log entries as clients send them: `fields` is still JSON text.
INGEST = _struct(
    ("service", T.StringType()),
    ("component", T.StringType()),
    ("timestamp", T.StringType()),
    ("level", T.StringType()),
    ("message", T.StringType()),
    ("path", T.StringType()),
    ("function", T.StringType()),
    ("line_number", T.IntegerType()),
    ("trace_id", T.StringType()),
    ("user_id", T.StringType()),
    ("fields", T.StringType()),
)

PARSED = _struct(
    ("timestamp", T.TimestampType()),
    ("level", T.StringType()),
    ("message", T.StringType()),
    ("service", T.StringType()),
    ("trace_id", T.StringType()),
    ("span_id", T.StringType()),
    ("fields", DYNAMIC),
    ("raw", T.StringType()),
    ("format", T.StringType()),
)

# The columns of the indexed document.
DOCUMENT = _struct(
    ("timestamp", T.TimestampType()),
    ("level", T.StringType()),
    ("message", T.StringType()),
    ("service", T.StringType()),
    ("trace_id", T.StringType()),
    ("span_id", T.StringType()),
    ("http_method", T.StringType()),
    ("http_path", T.StringType()),
    ("http_status", T.IntegerType()),
    ("user_id", T.StringType()),
    ("business_domain", T.StringType()),
    ("tenant_id", T.StringType()),
    ("is_error", T.BooleanType()),
    ("error_type", T.StringType()),
    # analysis of free text; null for other formats
    ("sentiment_score", T.DoubleType()),
    ("sentiment_label", T.StringType()),
    ("language", T.StringType()),
    ("category", T.StringType()),
    ("keywords", T.ArrayType(T.StringType())),
    ("entities", ENTITIES),
    ("fields", DYNAMIC),
)

# As stored: with the id.
DOCUMENTS = T.StructType([T.StructField("id", T.StringType()), *DOCUMENT])

# Rule, filter and strategy tables hold one JSON document per row.
RULE_STORE = _struct(("id", T.StringType()), ("scope", T.StringType()), ("body", T.StringType()))

RULE_VERSION = _struct(
    ("id", T.StringType()),
    ("rule_id", T.StringType()),
    ("version", T.LongType()),
    ("content", T.StringType()),
    ("author", T.StringType()),
    ("comment", T.StringType()),
    ("created_at", T.TimestampType()),
)

TRAINING_SAMPLE = _struct(("log", T.StringType()), ("expected_format", T.StringType()), ("source", T.StringType()))

ALERT = _struct(
    ("id", T.StringType()),
    ("rule_id", T.StringType()),
    ("service", T.StringType()),
    ("message", T.StringType()),
    ("level", T.StringType()),
    ("trigger_time", T.TimestampType()),
    ("status", T.StringType()),
    ("count", T.LongType()),
    ("window", T.LongType()),
)
