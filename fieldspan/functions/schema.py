"""User schemas: fields with kinds, units and groups, and the Spark types of their records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

KINDS: dict[str, T.DataType] = {"str": T.StringType(), "bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "money": T.DecimalType(38, 9), "date": T.DateType(), "enum": T.StringType()}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "str"
    description: str = ""
    unit: str | None = None
    group: str | None = None
    options: tuple[str, ...] = ()
    many: bool = False
    required: bool = True

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"no kind {self.kind!r}")
        if (self.kind == "enum") != bool(self.options):
            raise ValueError("an enum, and only an enum, has options")

    def type(self) -> T.DataType:
        own = KINDS[self.kind]
        return T.ArrayType(own) if self.many else own

    def label(self) -> str:
        return self.name.replace("_", " ") + (f" ({self.unit})" if self.unit else "")


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...]
    description: str = ""

    def record_type(self, partial: bool = False) -> T.StructType:
        """The type of a record; a partial one may lack any field."""
        return T.StructType([T.StructField(f.name, f.type(), partial or not f.required) for f in self.fields])

    def groups(self) -> dict[str, tuple[Field, ...]]:
        """Fields by group; one without a group is alone."""
        out: dict[str, tuple[Field, ...]] = {}
        for f in self.fields:
            out[f.group or f.name] = (*out.get(f.group or f.name, ()), f)
        return out

    def document_question(self) -> str:
        return f"Does the text describe a {self.description or self.name}?"

    def group_questions(self) -> dict[str, str]:
        return {g: f"Does the text state {', '.join(f.label() for f in fields)}?" for g, fields in self.groups().items()}

    def category_options(self) -> list[str]:
        return [*(f.label() for f in self.fields), "none"]

    def values(self) -> list[str]:
        return [f.name for f in self.fields]
