"""Semantic enrichment: HTTP, user, error, domain, tenant and business attributes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from logweir.functions.fields import empty_fields
from logweir.functions.steps import compute_once
from logweir.functions.words import trim_space

# Fixed values.
REQUEST = r"^[^\S\n]*(\S+)[^\S\n]+(\S+)[^\S\n]+([+-]?\d+)"
IP = r"(?<!\w)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w)"
URL = r"https?://[^\s]+"
ERROR_DETAIL = r"(?i)(error|exception|failed|failure)[:\s]+([^\n]+)"
DOMAINS = {
    "order-service": "commerce",
    "payment-service": "commerce",
    "user-service": "identity",
    "auth-service": "identity",
    "content-service": "content",
}
CRITICAL = "payment|order|auth|user"
SENSITIVE = "password|token|secret|key|credential|privacy"
ANALYSIS_FIELDS = ("sentiment_score", "sentiment_label", "language", "keywords", "entities")


def _get(fields: str, key: str) -> Column:
    return F.try_element_at(F.col(fields), F.lit(key))


def _string(v: Column) -> Column:
    """A variant as text if it is a string, else empty."""
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", v.cast("string")), F.lit(""))


def http_columns(message: Column) -> dict[str, Column]:
    """``METHOD path status`` at the head of the message; ``200ms`` reads as 200."""
    hit = message.rlike(REQUEST)
    part = lambda i: F.when(hit, F.regexp_extract(message, REQUEST, i))
    return {"http_method": part(1), "http_path": part(2), "http_status": part(3).try_cast("int")}


def domain(service: Column, pairs: dict[str, str] = DOMAINS) -> Column:
    out = F.when(F.lit(False), "")
    for name in sorted(set(pairs.values())):
        out = out.when(service.isin([s for s, d in pairs.items() if d == name]), name)
    return out.otherwise("general")


def with_domain(df: DataFrame, domains: DataFrame) -> DataFrame:
    """Business domain from a dimension table (service, business_domain), one row per service.

    The join strategy is left to the planner, which knows the table's size.
    """
    dim = domains.select("service", "business_domain").dropDuplicates(["service"])
    return df.join(dim, "service", "left").withColumn("business_domain", F.coalesce("business_domain", F.lit("general")))


def message_columns(message: Column) -> dict[str, Column]:
    return {
        "detected_ip": F.when(message.rlike(IP), F.regexp_extract(message, IP, 0)),
        "detected_url": F.when(message.rlike(URL), F.regexp_extract(message, URL, 0)),
        "error_detail": F.when(message.rlike(ERROR_DETAIL), trim_space(F.regexp_extract(message, ERROR_DETAIL, 2))),
    }


def attribute_columns(service: Column, message: Column) -> dict[str, Column]:
    service, message = F.lower(service), F.lower(message)
    return {
        "api_type": F.when(service.contains("api") | service.contains("gateway"), "gateway").when(service.contains("internal"), "internal"),
        "request_type": F.when(message.contains("get "), "read").when(
            message.contains("post ") | message.contains("put ") | message.contains("create"), "write"
        ),
        "is_critical": F.when(service.rlike(CRITICAL), True),
        "is_sensitive": F.when(message.rlike(SENSITIVE), True),
    }


def level_from_status(status: Column) -> Column:
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO")


def enrich_logs(
    df: DataFrame,
    *,
    fields: str = "fields",
    domains: DataFrame | None = None,
    steps: list[Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """Adds the document columns and merges what was found into the fields map.

    ``is_error`` is the document flag, true when an error type is known; ``level_is_error`` follows
    the level. ``domains`` replaces the built-in service table. ``steps`` are further enrichers.
    """
    level, message, service = F.col("level"), F.col("message"), F.col("service")
    failed = level.isin("ERROR", "FATAL")
    http = http_columns(message)
    # a JSON number is no HTTP status here; access-log parsers store a whole number
    stored = F.try_variant_get(_get(fields, "http_status"), "$", "int")
    if "format" in df.columns:
        stored = F.when(F.col("format") != "json", stored)
    user = F.coalesce(_get(fields, "uid"), _get(fields, "user_id"))
    tenant = F.coalesce(_get(fields, "org_id"), _get(fields, "tenant_id"))
    error_type = F.coalesce(
        _get(fields, "error_type"), F.when(failed, _get(fields, "exception"))
    )
    found = {**message_columns(message), **attribute_columns(service, message)}
    out = compute_once(
        df,
        {
            "_http": F.struct(*[c.alias(k) for k, c in http.items()]),
            "_user": user,
            "_tenant": tenant,
            "_error": error_type,
            "_found": F.struct(*[c.alias(k) for k, c in found.items()]),
            "_analysed": _get(fields, "category"),
            "_stored_status": stored,
        },
    )
    if domains is not None:
        out = with_domain(out, domains)
    else:
        out = out.withColumn("business_domain", domain(service))
    values: list[tuple[str, Column]] = [
        *[(k, F.col(f"_http.{k}").cast("variant")) for k in http],
        ("category", F.when(F.col("_http.http_method").isNotNull(), F.lit("http_request")).cast("variant")),
        ("user_id", F.col("_user")),
        ("is_error", F.when(failed, True).cast("variant")),
        ("error_type", F.when(failed, F.col("_error"))),
        ("analysis_category", F.col("_analysed")),
        *[(k, F.col(f"_found.{k}").cast("variant")) for k in found],
        ("business_domain", F.col("business_domain").cast("variant")),
        ("tenant_id", F.col("_tenant")),
    ]
    added = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values]), lambda e: e["value"].isNotNull())
    columns = {
        "http_method": F.coalesce("_http.http_method", _string(_get(fields, "http_method"))),
        "http_path": F.coalesce("_http.http_path", _string(_get(fields, "http_path"))),
        "http_status": F.coalesce("_http.http_status", "_stored_status", F.lit(0)),
        "user_id": _string(F.col("_user")),
        "tenant_id": _string(F.col("_tenant")),
        "is_error": F.col("_error").isNotNull(),
        "level_is_error": failed,
        "error_type": _string(F.col("_error")),
        **{k: F.col(f"_found.{k}") for k in found},
        fields: F.map_concat(F.coalesce(fields, empty_fields()), F.map_from_entries(added)),
    }
    out = out.withColumns(columns).drop("_http", "_user", "_tenant", "_error", "_found", "_analysed", "_stored_status")
    for step in steps or []:
        out = out.transform(step)
    return out
