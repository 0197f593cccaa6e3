"""Field transforms: rules that fill ``extracted`` from a source field."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from logweir.functions.fields import variant_path
from logweir.functions.regex import group_labels, java_pattern
from logweir.functions.values import variant_text
from logweir.functions.words import trim_space

STANDARD = ("message", "raw", "level", "service", "trace_id", "span_id")
ANALYSIS = ("sentiment_score", "sentiment_label", "language", "category")

# An extractor turns the source text and the rule's config into a variant Column.
Extractor = Callable[[Column, dict], Column]


@dataclass(frozen=True)
class TransformRule:
    name: str
    source_field: str
    target_field: str
    extractor: str
    config: dict = field(default_factory=dict)
    enabled: bool = True

    @classmethod
    def parse(cls, doc: dict) -> TransformRule:
        return cls(
            doc.get("name") or "",
            doc.get("source_field") or "",
            doc.get("target_field") or "",
            doc.get("extractor") or "",
            doc.get("config") or {},
            bool(doc.get("enabled", False)),
        )

    def validate(self) -> None:
        for attr in ("name", "source_field", "target_field", "extractor"):
            if not getattr(self, attr):
                raise ValueError(f"{attr} cannot be empty")
        if self.extractor == "regex" and isinstance(self.config.get("pattern"), str):
            java_pattern(self.config["pattern"])


class TransformRules:
    """An ordered rule list; adding replaces a rule of the same name, applying appends."""

    def __init__(self, rules: list[TransformRule] | None = None):
        self.rules: list[TransformRule] = []
        self.apply(rules or [])

    def add(self, rule: TransformRule) -> None:
        rule.validate()
        for i, old in enumerate(self.rules):
            if old.name == rule.name:
                self.rules[i] = rule
                return
        self.rules.append(rule)

    def apply(self, rules: list[TransformRule]) -> None:
        for rule in rules:
            rule.validate()
            self.rules.append(rule)

    def remove(self, name: str) -> None:
        for i, rule in enumerate(self.rules):
            if rule.name == name:
                del self.rules[i]
                return
        raise KeyError(name)


def _regex(source: Column, config: dict) -> Column:
    pattern = config["pattern"]
    java, labels = java_pattern(pattern), group_labels(pattern)
    hit = source.rlike(java)
    if any(labels):
        named = [x for i, n in enumerate(labels, 1) if n for x in (F.lit(n), F.regexp_extract(source, java, i).cast("variant"))]
        value = F.to_variant_object(F.create_map(*named))
    else:
        value = F.regexp_extract(source, java, 1 if labels else 0).cast("variant")
    return F.when(hit, value).otherwise(F.parse_json(F.lit("null")))


def _split(source: Column, config: dict) -> Column:
    delimiter = config["delimiter"] if isinstance(config.get("delimiter"), str) else ","
    literal = "\\Q" + delimiter + "\\E" if delimiter else ""
    parts = F.filter(F.transform(F.split(source, literal, -1), trim_space), lambda p: p != "")
    return parts.cast("variant")


def _jsonpath(source: Column, config: dict) -> Column:
    path = config.get("path") or "$"
    return F.coalesce(F.try_variant_get(F.try_parse_json(source), path, "variant"), F.parse_json(F.lit("null")))


EXTRACTORS: dict[str, Extractor] = {
    "regex": _regex,
    "template": lambda s, c: F.replace(F.lit(c["template"]), F.lit("{{source}}"), s).cast("variant"),
    "direct": lambda s, c: s.cast("variant"),
    "lowercase": lambda s, c: F.lower(s).cast("variant"),
    "uppercase": lambda s, c: F.upper(s).cast("variant"),
    "split": _split,
    "jsonpath": _jsonpath,
}


def source_value(df: DataFrame, name: str, fields: str = "fields") -> Column:
    """Text of a source: header column, then dynamic field, then analysis value, then first entity of that type."""
    if name in STANDARD and name in df.columns:
        return F.col(name)
    options = []
    if fields in df.columns:
        options.append(variant_text(F.try_element_at(F.col(fields), F.lit(name))))
    if name in ANALYSIS and "sentiment" in df.columns:
        options.append(
            {
                "sentiment_score": F.format_string("%.6f", F.col("sentiment.score")),
                "sentiment_label": F.col("sentiment.label"),
                "language": F.col("language"),
                "category": F.col("category"),
            }[name]
        )
    elif "entities" in df.columns:
        options.append(F.get(F.filter("entities", lambda e: e["type"] == name), F.lit(0))["value"])
    return F.coalesce(*options) if options else F.lit("")


def analysis_entries(df: DataFrame) -> Column:
    """``entity_{TYPE}_{n}`` and ``keywords`` as map entries."""
    entries = F.transform(
        F.col("entities"),
        lambda e, i: F.struct(
            F.concat(F.lit("entity_"), e["type"], F.lit("_"), i.cast("string")).alias("key"), e["value"].cast("variant").alias("value")
        ),
    )
    words = F.when(
        F.size("keywords") > 0, F.array(F.struct(F.lit("keywords").alias("key"), F.col("keywords").cast("variant").alias("value")))
    )
    empty = F.array().cast("array<struct<key:string,value:variant>>")
    return F.concat(F.coalesce(entries, empty), F.coalesce(words, empty))


def transform_logs(
    df: DataFrame, rules: TransformRules | list[TransformRule], *, extractors: dict[str, Extractor] | None = None, fields: str = "fields"
) -> DataFrame:
    """Adds ``extracted``, a map of the rules' targets (and of the analysis, where the table has one).

    An empty source, an unknown extractor or a rule without its required config stores nothing.
    """
    known = {**EXTRACTORS, **(extractors or {})}
    entries = []
    for rule in rules.rules if isinstance(rules, TransformRules) else rules:
        needs = {"regex": "pattern", "template": "template"}.get(rule.extractor)
        if not rule.enabled or rule.extractor not in known or (needs and not isinstance(rule.config.get(needs), str)):
            continue
        source = source_value(df, rule.source_field, fields)
        value = known[rule.extractor](source, rule.config)
        entries.append(
            F.when(F.coalesce(source, F.lit("")) != "", F.struct(F.lit(rule.target_field).alias("key"), value.alias("value")))
        )
    empty = F.array().cast("array<struct<key:string,value:variant>>")
    out = F.array_compact(F.array(*entries)).cast("array<struct<key:string,value:variant>>") if entries else empty
    if "entities" in df.columns and "keywords" in df.columns:
        out = F.concat(analysis_entries(df), out)
    return df.withColumn("extracted", F.map_from_entries(out))


def nested(column: str, *keys: str) -> Column:
    """Text below a top-level key of a map of variants."""
    return F.try_variant_get(F.try_element_at(F.col(column), F.lit(keys[0])), variant_path(keys[1:]), "string")
