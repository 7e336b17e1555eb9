"""Generator specs as YAML and their JSON schema; user schemas from data classes."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import enum
import types
import typing

from fieldspan.functions.schema import Field, Schema
from fieldspan.operators.generators import check_pattern

MOST = 20_000
KEYS = {"id": str, "field": str, "pattern": str, "group": int, "locales": list, "sources": list, "place": int}
REQUIRED = ("id", "field", "pattern")


def from_yaml(text: str) -> dict:
    """A spec of known keys, without aliases or repeated keys, of at most 20,000 characters; its pattern is checked."""
    import yaml

    if len(text) > MOST:
        raise ValueError(f"a spec has at most {MOST} characters")

    class Strict(yaml.SafeLoader):
        def compose_node(self, parent, index):
            if self.check_event(yaml.events.AliasEvent):
                raise ValueError("a spec has no aliases")
            return super().compose_node(parent, index)

        def construct_mapping(self, node, deep=False):
            names = [k.value for k, _ in node.value]
            if len(set(names)) < len(names):
                raise ValueError("a key is repeated")
            return super().construct_mapping(node, deep)

    found = yaml.load(text, Strict)
    if not isinstance(found, dict) or (odd := set(found) - set(KEYS)) or (odd := set(REQUIRED) - set(found)):
        raise ValueError("a spec is a mapping" if not isinstance(found, dict) else f"unknown or missing: {', '.join(sorted(odd))}")
    for key, value in found.items():
        if not isinstance(value, KEYS[key]) or isinstance(value, bool):
            raise ValueError(f"{key} is a {KEYS[key].__name__}")
    check_pattern(found["pattern"])
    return {"group": 0, "locales": [], "sources": [], "place": 0} | found


def json_schema() -> dict:
    kinds = {str: {"type": "string"}, int: {"type": "integer"}, list: {"type": "array", "items": {"type": "string"}}}
    return {"type": "object", "properties": {k: kinds[t] for k, t in KEYS.items()}, "required": list(REQUIRED), "additionalProperties": False}


_KINDS = {str: "str", bool: "bool", int: "int", float: "float", decimal.Decimal: "money", datetime.date: "date"}


def schema_of(model: type) -> Schema:
    """The schema of a data class: its annotations are the kinds, X | None isn't required, list[X] has many, an Enum or Literal has options.

    A field's metadata may have description, unit and group.
    """
    if not dataclasses.is_dataclass(model):
        raise ValueError("a schema is made of a data class")
    hints, out = typing.get_type_hints(model), []
    for f in dataclasses.fields(model):
        kind, required, many, options = hints[f.name], True, False, ()
        if typing.get_origin(kind) in (types.UnionType, typing.Union):
            inner = [a for a in typing.get_args(kind) if a is not type(None)]
            required = len(inner) == len(typing.get_args(kind))
            if len(inner) != 1:
                raise ValueError(f"{f.name} has one kind")
            kind = inner[0]
        if typing.get_origin(kind) is list:
            many, kind = True, typing.get_args(kind)[0]
        if typing.get_origin(kind) is typing.Literal:
            options, name = tuple(map(str, typing.get_args(kind))), "enum"
        elif isinstance(kind, type) and issubclass(kind, enum.Enum):
            options, name = tuple(str(o.value) for o in kind), "enum"
        elif kind in _KINDS:
            name = _KINDS[kind]
        else:
            raise ValueError(f"{f.name}: no kind for {kind}")
        extra = {k: f.metadata[k] for k in ("description", "unit", "group") if k in f.metadata}
        out.append(Field(f.name, name, options=options, many=many, required=required, **extra))
    return Schema(model.__name__, tuple(out), (model.__doc__ or "").strip().split("\n")[0])
