"""The log pipeline as a stream: lines in, documents out.

Everything up to the sink is narrow. Rules are read again at the start of every
micro-batch, so a changed rule table takes effect without a restart, and a
replayed batch writes the same document ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from logweir.functions.steps import compute_once
from logweir.operators.model import Rule
from logweir.operators.parse import parse_logs
from logweir.operators.rules import Options, apply_rules
from logweir.operators.semantic import enrich_logs
from logweir.operators.text import analyze_text
from logweir.operators.transform import TransformRules, transform_logs
from logweir.sources import sinks

TRIGGER = "5 seconds"


def process(
    lines: DataFrame,
    *,
    rules: list[Rule] | None = None,
    transforms: TransformRules | None = None,
    ingest: str = "ingest_ts",
    edits: bool = True,
) -> DataFrame:
    """Lines (``raw`` and an ingest time) to documents: parse, filter, analyse free text, transform, enrich."""
    when = F.col(ingest).cast("timestamp")
    logs = parse_logs(lines, ingest_ts=when, year=F.year(when))
    if rules:
        logs = apply_rules(logs, rules, Options(shadow=True, key="raw", edits=edits))
    # free text is always analysed
    logs = analyze_text(logs, where=F.col("format") == "unstructured")
    if transforms is not None:
        logs = transform_logs(logs, transforms)
        logs = compute_once(logs, {"fields": F.map_concat("fields", "extracted")}).drop("extracted")
    return sinks.documents(enrich_logs(logs).withColumns({"sentiment_score": F.col("sentiment.score"), "sentiment_label": F.col("sentiment.label")}))


def start(
    lines: DataFrame,
    out: str,
    checkpoint: str,
    *,
    load_rules: Callable[[], list[Rule]] | None = None,
    transforms: TransformRules | None = None,
    extra_sinks: list[Callable[[DataFrame], None]] | None = None,
    trigger: dict | None = None,
):
    """Run the pipeline into an upserted table. ``load_rules`` is called once per micro-batch."""

    def batch(df: DataFrame, number: int) -> None:
        docs = process(df, rules=load_rules() if load_rules else None, transforms=transforms)
        order = F.struct("timestamp", "message")
        error = sinks.write_all(docs, [lambda d: sinks.upsert(d, out, order, number), *(extra_sinks or [])])
        if error is not None:
            raise error

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": TRIGGER})).start()
