"""Field addressing on a log row: standard columns plus one ``map<string,variant>`` column.

``a.b.c`` reads key ``a`` of the map and follows the rest inside the variant.
``fields.x`` is accepted for ``x``. With ``shadow`` a key of the map hides the
standard column of the same name.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logweir.functions.values import Value, column_value, variant_value


@dataclass(frozen=True)
class Place:
    """Where a field lives: a standard column, or a path below the fields map."""

    column: str | None
    path: tuple[str, ...] = ()

    @property
    def token(self) -> str:
        """What two places share when an edit of one can be seen through the other."""
        return self.column if self.column else f"fields.{self.path[0]}"


def variant_path(keys: tuple[str, ...]) -> str:
    return "$" + "".join('["' + k.replace("\\", "\\\\").replace('"', '\\"') + '"]' for k in keys)


def json_literal(value) -> Column:
    return F.parse_json(F.lit(json.dumps(value, ensure_ascii=False)))


def empty_fields() -> Column:
    return F.from_json(F.lit("{}"), T.MapType(T.StringType(), T.VariantType()))


class Entry:
    """The columns of a table of log entries, as rules address them."""

    def __init__(self, columns: dict[str, T.DataType], fields: str | None, shadow: bool = False):
        self.columns = {k: v for k, v in columns.items() if k != fields}
        self.fields = fields if fields in columns else None
        self.shadow = shadow and self.fields is not None

    @classmethod
    def of(cls, df: DataFrame, fields: str | None = "fields", shadow: bool = False) -> Entry:
        return cls({f.name: f.dataType for f in df.schema.fields}, fields, shadow)

    def place(self, name: str) -> Place:
        parts = tuple(name.split("."))
        if len(parts) > 1 and parts[0] == self.fields and "fields" not in self.columns:
            parts = parts[1:]
        if len(parts) == 1 and parts[0] in self.columns:
            return Place(parts[0])
        return Place(None, parts)

    def field(self, key: str) -> Column:
        """The variant under a top-level key, null when the key is missing."""
        return F.try_element_at(F.col(self.fields), F.lit(key))

    def value(self, name: str) -> Value:
        place = self.place(name)
        if place.column:
            col, kind = F.col(place.column), self.columns[place.column]
            if self.shadow:
                return variant_value(F.coalesce(self.field(place.column), col.cast("variant")))
            return column_value(col, kind)
        if self.fields is None or place.path[0] in self.columns:
            # a path below a scalar column, or no dynamic fields at all: never present
            return column_value(F.lit(None).cast("string"), T.StringType())
        found = self.field(place.path[0])
        if len(place.path) > 1:
            found = F.try_variant_get(found, variant_path(place.path[1:]), "variant")
        return variant_value(found)

    def settable(self, name: str) -> Column | None:
        """None when a set always works; else whether every parent is missing or an object."""
        place = self.place(name)
        if place.column:
            return None
        if self.fields is None or place.path[0] in self.columns:
            return F.lit(False)
        checks = []
        for depth in range(1, len(place.path)):
            parent = self.field(place.path[0])
            if depth > 1:
                parent = F.try_variant_get(parent, variant_path(place.path[1:depth]), "variant")
            checks.append(parent.isNull() | F.schema_of_variant(parent).startswith("OBJECT"))
        if not checks:
            return None
        both = checks[0]
        for check in checks[1:]:
            both = both & check
        return both

    def put(self, name: str, value: Column) -> list[Write]:
        """Store a variant under ``name``, building missing parents."""
        place = self.place(name)
        if place.column:
            kind = self.columns[place.column]
            text = value.cast("string") if isinstance(kind, T.StringType) else F.try_variant_get(value, "$", kind.simpleString())
            writes = [Write(column=place.column, value=text)]
            if self.shadow:
                writes.append(Write(key=place.column, drop=True))
            return writes
        head, tail = place.path[0], place.path[1:]
        return [Write(key=head, value=_nest(self.field(head), tail, value) if tail else value)]

    def delete(self, name: str) -> list[Write]:
        place = self.place(name)
        if place.column:
            writes = [Write(column=place.column, value=F.lit(None).cast(self.columns[place.column]))]
            if self.shadow:
                writes.append(Write(key=place.column, drop=True))
            return writes
        head, tail = place.path[0], place.path[1:]
        if not tail:
            return [Write(key=head, drop=True)]
        return [Write(key=head, value=_without(self.field(head), tail))]

    def move(self, source: Place, target: Place) -> list[Write]:
        """Rename within one top-level key."""
        head = source.path[0]
        if len(source.path) == 1:
            return [Write(key=head, drop=True)]
        moved = F.try_variant_get(self.field(head), variant_path(source.path[1:]), "variant")
        if len(target.path) == 1:
            return [Write(key=head, value=moved)]
        return [Write(key=head, value=_without(_nest(self.field(head), target.path[1:], moved), source.path[1:]))]

    def delete_all(self, names: list[str]) -> list[tuple[Column, Write]]:
        """Guarded deletes of several fields; paths below one key are taken off its value in turn."""
        writes: list[tuple[Column, Write]] = []
        nested: dict[str, list[tuple[str, ...]]] = {}
        whole = {self.place(n).path[0] for n in names if not self.place(n).column and len(self.place(n).path) == 1}
        for name in names:
            place = self.place(name)
            if place.column or len(place.path) == 1:
                writes += [(self.value(name).present, w) for w in self.delete(name)]
            elif place.path[0] not in whole and self.fields and place.path[0] not in self.columns:
                nested.setdefault(place.path[0], []).append(place.path[1:])
        for head, tails in nested.items():
            value = self.field(head)
            for tail in tails:
                found = F.try_variant_get(value, variant_path(tail), "variant").isNotNull()
                value = F.when(found, _without(value, tail)).otherwise(value)
            writes.append((self.field(head).isNotNull(), Write(key=head, value=value)))
        return writes

    def apply(self, writes: list[tuple[Column, Write]]) -> dict[str, Column]:
        """New columns after guarded writes. No two writes share a target."""
        out: dict[str, Column] = {}
        dropped, added = [], []
        for guard, write in writes:
            if write.column:
                out[write.column] = F.when(guard, write.value).otherwise(F.col(write.column))
            elif write.drop:
                dropped.append((guard, write.key))
            else:
                added.append((guard, write))
        if dropped or added:
            fields = F.coalesce(F.col(self.fields), empty_fields())
            if dropped:
                # one pass over the map for all removals
                fields = F.map_filter(fields, lambda k, _: ~_any([(k == F.lit(key)) & guard for guard, key in dropped]))
            if added:
                fields = F.map_concat(
                    fields, *[F.when(guard, F.create_map(F.lit(w.key), w.value)).otherwise(empty_fields()) for guard, w in added]
                )
            out[self.fields] = fields
        return out


@dataclass(frozen=True)
class Write:
    """One change: a standard column gets a value, or a top-level key of the map is put or dropped."""

    column: str | None = None
    key: str | None = None
    value: Column | None = None
    drop: bool = False


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _object(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), empty_fields())


def _nest(old: Column, tail: tuple[str, ...], value: Column) -> Column:
    key, rest = tail[0], tail[1:]
    inner = _nest(F.try_variant_get(old, variant_path((key,)), "variant"), rest, value) if rest else value
    return F.to_variant_object(F.map_concat(_object(old), F.create_map(F.lit(key), inner)))


def _without(old: Column, tail: tuple[str, ...]) -> Column:
    key, rest = tail[0], tail[1:]
    if not rest:
        return F.to_variant_object(F.map_filter(_object(old), lambda k, _: k != F.lit(key)))
    inner = _without(F.try_variant_get(old, variant_path((key,)), "variant"), rest)
    return F.to_variant_object(F.map_concat(_object(old), F.create_map(F.lit(key), inner)))
