"""Rule actions as effects on Columns.

An effect says where it applies, whether it succeeds there, what it writes and
what the row's keep decision becomes. Nothing here touches a DataFrame: the rule
engine places effects in projections.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from logweir.functions.fields import Entry, Write, json_literal
from logweir.functions.regex import InvalidPattern, group_labels, java_pattern
from logweir.functions.values import Value
from logweir.functions.words import byte_prefix
from logweir.operators.model import Action, Rule


@dataclass(frozen=True)
class Effect:
    ok: Column | None = None  # None: always succeeds
    error: str = ""  # text when it does not
    keep: Column | None = None  # None: true
    writes: list[tuple[Column | None, Write]] = field(default_factory=list)  # (guard or None, write)
    metadata: dict[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Context:
    entry: Entry
    rule: Rule
    position: int  # of the action in its rule
    key: Column  # identity of the row, for sampling
    seed: int


Handler = Callable[[Context, Action], Effect]


def failed(error: str) -> Effect:
    return Effect(ok=F.lit(False), error=error)


def touched(entry: Entry, action: Action) -> set[str]:
    """Places an action reads or writes; two actions that share one cannot sit in one projection."""
    names = [action.text(k) for k in ("field", "source_field", "target_field", "from", "to")] + action.texts("fields")
    if action.type == "mark" and not action.text("field"):
        names.append("_tags")
    return {entry.place(n).token for n in names if n}


def written(entry: Entry, action: Action) -> set[str]:
    if action.type in ("keep", "drop", "sample"):
        return set()
    if action.type == "extract":
        return {entry.place(action.text("target_field")).token} if action.text("target_field") else set()
    return touched(entry, action)


def unit_hash(key: Column, *salt: object) -> Column:
    """A number in [0, 1) that depends only on the row's key and the salt."""
    text = F.concat_ws(":", key.cast("string"), *[F.lit(str(s)) for s in salt])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _sample(ctx: Context, action: Action) -> Effect:
    rate = float(action.number("rate", 1.0))
    salt = (ctx.rule.id, ctx.seed) if ctx.position == 0 else (ctx.rule.id, ctx.seed, ctx.position)
    kept = unit_hash(ctx.key, *salt) < rate
    return Effect(keep=kept, metadata={"action": F.lit("sample"), "rate": F.lit(rate), "kept": kept})


def _string_ok(value: Value) -> Column | None:
    return None if value.string is None else ~value.present | value.string


def mask_matches(text: Column, pattern: str | None, character: str) -> Column:
    """Each match becomes ``character`` once per byte of the match; without a pattern the whole text does."""
    if pattern is None:
        return F.repeat(F.lit(character), F.octet_length(text))
    # odd pieces of the marked text are matches
    marked = F.split(F.regexp_replace(text, f"({pattern})", "\x01$1\x02"), "[\x01\x02]", -1)
    pieces = F.transform(marked, lambda x, i: F.when(i % 2 == 1, F.repeat(F.lit(character), F.octet_length(x))).otherwise(x))
    # a text that already holds a marker is cut around its matches instead
    cut = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    woven = F.array_join(
        F.transform(cut, lambda x, i: F.concat(x, F.coalesce(F.repeat(F.lit(character), F.octet_length(F.get(found, i))), F.lit("")))), ""
    )
    return F.when(text.rlike("[\x01\x02]"), woven).when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def _mask(ctx: Context, action: Action) -> Effect:
    name, pattern = action.text("field"), action.text("pattern")
    if not name:
        return failed("mask needs a field")
    value = ctx.entry.value(name)
    try:
        java = java_pattern(pattern) if pattern else None
    except InvalidPattern as err:
        return Effect(ok=~value.present, error=str(err))
    masked = mask_matches(value.plain, java, action.text("character", "*"))
    return Effect(
        ok=_string_ok(value),
        error=f"field {name} is not a string",
        writes=[(value.present, w) for w in ctx.entry.put(name, masked.cast("variant"))],
        metadata={"action": F.lit("mask"), "field": F.lit(name)},
    )


def _truncate(ctx: Context, action: Action) -> Effect:
    name, limit, suffix = action.text("field"), int(action.number("max_length", 1000)), action.text("suffix", "...")
    if not name:
        return failed("truncate needs a field")
    value = ctx.entry.value(name)
    size = F.octet_length(value.plain)
    cut = F.concat(byte_prefix(value.plain, limit), F.lit(suffix))
    return Effect(
        ok=_string_ok(value),
        error=f"field {name} is not a string",
        writes=[(value.present & (size > limit), w) for w in ctx.entry.put(name, cut.cast("variant"))],
        metadata={"action": F.lit("truncate"), "field": F.lit(name), "original": size, "truncated": F.octet_length(cut)},
    )


def _extract(ctx: Context, action: Action) -> Effect:
    source, target, pattern = action.text("source_field"), action.text("target_field"), action.text("pattern")
    group = int(action.number("group", 1))
    if not (source and target and pattern):
        return failed("extract needs source_field, target_field and pattern")
    value = ctx.entry.value(source)
    try:
        java = java_pattern(pattern)
    except InvalidPattern as err:
        return Effect(ok=~value.present, error=str(err))
    if group > len(group_labels(pattern)):
        return Effect(ok=_string_ok(value), error=f"source field {source} is not a string")
    found = F.regexp_extract(value.plain, java, group)
    hit = value.present & value.plain.rlike(java)
    return Effect(
        ok=_both(_string_ok(value), _unless(hit, ctx.entry.settable(target))),
        error=f"cannot extract {source} into {target}",
        writes=[(hit, w) for w in ctx.entry.put(target, found.cast("variant"))],
        metadata={"action": F.lit("extract"), "source_field": F.lit(source), "target_field": F.lit(target), "extracted": found},
    )


def _rename(ctx: Context, action: Action) -> Effect:
    old, new = action.text("from"), action.text("to")
    if not (old and new):
        return failed("rename needs from and to")
    entry, value = ctx.entry, ctx.entry.value(old)
    source, target = entry.place(old), entry.place(new)
    if old == new:
        writes = entry.delete(old)
    elif not source.column and not target.column and source.path[0] == target.path[0]:
        writes = entry.move(source, target)
    else:
        writes = entry.put(new, value.raw.cast("variant")) + entry.delete(old)
    return Effect(
        ok=_unless(value.present, entry.settable(new)),
        error=f"cannot rename {old} to {new}",
        writes=[(value.present, w) for w in writes],
        metadata={"action": F.lit("rename"), "from": F.lit(old), "to": F.lit(new), "renamed": value.present},
    )


def _remove(ctx: Context, action: Action) -> Effect:
    names = ([action.text("field")] if action.text("field") else []) + action.texts("fields")
    if not names:
        return failed("remove needs field or fields")
    names = list(dict.fromkeys(names))
    removed = [F.when(ctx.entry.value(name).present, F.lit(name)) for name in names]
    return Effect(
        writes=ctx.entry.delete_all(names),
        metadata={"action": F.lit("remove"), "removed": F.concat_ws(",", *removed)},
    )


def _store(ctx: Context, name: str, action: Action, kind: str) -> Effect:
    value = action.config.get("value")
    return Effect(
        ok=ctx.entry.settable(name),
        error=f"cannot set nested field {name} on a value that is not a map",
        writes=[(None, w) for w in ctx.entry.put(name, json_literal(value))],
        metadata={"action": F.lit(kind), "field": F.lit(name), "value": F.to_json(F.create_map(F.lit("value"), json_literal(value)))},
    )


def _set(ctx: Context, action: Action) -> Effect:
    name = action.text("field")
    return _store(ctx, name, action, "set") if name else failed("set needs a field")


def _mark(ctx: Context, action: Action) -> Effect:
    effect = _store(ctx, action.text("field", "_tags") or "_tags", action, "mark")
    effect.metadata["reason"] = F.lit(action.text("reason"))
    return effect


def _unless(guard: Column, allowed: Column | None) -> Column | None:
    return None if allowed is None else ~guard | allowed


def _both(a: Column | None, b: Column | None) -> Column | None:
    if a is None or b is None:
        return a if b is None else b
    return a & b


BUILT_IN: dict[str, Handler] = {
    "keep": lambda ctx, action: Effect(keep=F.lit(True), metadata={"action": F.lit("keep")}),
    "drop": lambda ctx, action: Effect(keep=F.lit(False), metadata={"action": F.lit("drop")}),
    "sample": _sample,
    "mask": _mask,
    "truncate": _truncate,
    "extract": _extract,
    "rename": _rename,
    "remove": _remove,
    "set": _set,
    "mark": _mark,
}


def compile_action(ctx: Context, action: Action, handlers: dict[str, Handler] | None = None) -> Effect:
    handler = (handlers or {}).get(action.type) or BUILT_IN.get(action.type)
    return handler(ctx, action) if handler else failed(f"unknown action type: {action.type}")
