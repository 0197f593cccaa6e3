"""Rules as data: a condition tree and a list of actions, read from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

OPERATORS = (
    "eq", "ne", "gt", "lt", "ge", "le", "contains", "starts_with", "ends_with", "matches", "in", "not_in", "exists", "not_exists",
)
ACTIONS = ("keep", "drop", "sample", "mask", "truncate", "extract", "rename", "remove", "set", "mark")


class RuleError(ValueError):
    """A rule that cannot be used."""


@dataclass(frozen=True)
class Condition:
    field: str = ""
    operator: str = ""
    value: Any = None
    all: tuple[Condition, ...] = ()
    any: tuple[Condition, ...] = ()
    negated: Condition | None = None

    @property
    def single(self) -> bool:
        return bool(self.field and self.operator)

    @property
    def composite(self) -> bool:
        return bool(self.all or self.any or self.negated)

    @classmethod
    def parse(cls, doc: dict | None) -> Condition:
        doc = doc or {}
        every, some, negated = doc.get("all"), doc.get("any"), doc.get("not")
        return cls(
            doc.get("field") or "",
            doc.get("operator") or "",
            doc.get("value"),
            tuple(map(cls.parse, every)) if every else (),
            tuple(map(cls.parse, some)) if some else (),
            None if negated is None else cls.parse(negated),
        )

    def to_doc(self) -> dict:
        doc: dict = {}
        if self.field:
            doc["field"] = self.field
        if self.operator:
            doc["operator"] = self.operator
        if self.value is not None:
            doc["value"] = self.value
        if self.all:
            doc["all"] = [c.to_doc() for c in self.all]
        if self.any:
            doc["any"] = [c.to_doc() for c in self.any]
        if self.negated:
            doc["not"] = self.negated.to_doc()
        return doc

    def validate(self, operators=OPERATORS) -> None:
        if self.single == self.composite:
            raise RuleError("a condition is either single or composite")
        if self.single:
            if self.operator not in operators:
                raise RuleError(f"unknown operator: {self.operator}")
            if self.value is None and self.operator not in ("exists", "not_exists"):
                raise RuleError(f"operator {self.operator} needs a value")
        for child in self.children():
            child.validate(operators)

    def children(self) -> tuple[Condition, ...]:
        return (*self.all, *self.any, *((self.negated,) if self.negated else ()))

    def leaves(self) -> list[Condition]:
        """Single conditions in the tree, left to right."""
        if not self.composite:
            return [self]
        return [leaf for child in self.children() for leaf in child.leaves()]


@dataclass(frozen=True)
class Action:
    type: str
    config: dict = field(default_factory=dict)

    def text(self, key: str, default: str = "") -> str:
        v = self.config.get(key)
        return v if isinstance(v, str) else default

    def number(self, key: str, default: float) -> float:
        v = self.config.get(key)
        return v if isinstance(v, (int, float)) and not isinstance(v, bool) else default

    def texts(self, key: str) -> list[str]:
        v = self.config.get(key)
        return [x for x in v if isinstance(x, str)] if isinstance(v, (list, tuple)) else []


@dataclass(frozen=True)
class Rule:
    id: str
    name: str = ""
    condition: Condition = Condition()
    actions: tuple[Action, ...] = ()
    enabled: bool = True
    priority: int = 0
    service: str = ""
    component: str = ""
    description: str = ""
    scope: str = ""  # namespace the rule was stored under; sorts before the id

    @classmethod
    def parse(cls, doc: dict | str, scope: str = "") -> Rule:
        if isinstance(doc, str):
            try:
                doc = json.loads(doc)
            except ValueError as err:
                raise RuleError(f"not JSON: {err}") from None
        if not isinstance(doc, dict):
            raise RuleError("a rule is a JSON object")
        return cls(
            id=doc.get("id") or "",
            name=doc.get("name") or "",
            condition=Condition.parse(doc.get("condition")),
            actions=tuple(Action(a.get("type") or "", a.get("config") or {}) for a in doc.get("actions") or ()),
            enabled=bool(doc.get("enabled", False)),
            priority=int(doc.get("priority") or 0),
            service=doc.get("service") or "",
            component=doc.get("component") or "",
            description=doc.get("description") or "",
            scope=scope,
        )

    def to_doc(self) -> dict:
        return {
            "id": self.id,
            "name": self.name,
            "description": self.description,
            "enabled": self.enabled,
            "priority": self.priority,
            "service": self.service,
            "component": self.component,
            "condition": self.condition.to_doc(),
            "actions": [{"type": a.type, "config": a.config} for a in self.actions],
        }

    def validate(self, operators=OPERATORS) -> None:
        if not self.id:
            raise RuleError("rule id is required")
        if not self.name:
            raise RuleError("rule name is required")
        self.condition.validate(operators)
        if any(not a.type for a in self.actions):
            raise RuleError("action type is required")

    @property
    def order(self) -> tuple[bytes, bytes]:
        return self.scope.encode(), self.id.encode()

    @property
    def terminates(self) -> bool:
        return any(a.type in ("keep", "drop") for a in self.actions)

    def with_condition(self, condition: Condition) -> Rule:
        return replace(self, condition=condition)


def in_order(rules) -> list[Rule]:
    """Enabled rules in evaluation order; of two with one key the later definition stands."""
    latest = {r.order: r for r in rules}
    return [latest[k] for k in sorted(latest) if latest[k].enabled]
