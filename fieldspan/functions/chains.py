"""Normaliser chains: named steps with arguments, compiled to one column expression."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldspan.functions import quantities, text, units

Step = Callable[..., Column]


@dataclass(frozen=True)
class NormaliserStep:
    name: str
    args: dict[str, object] = field(default_factory=dict)

    def __str__(self) -> str:
        return self.name if not self.args else f"{self.name}({', '.join(f'{k}={v}' for k, v in sorted(self.args.items()))})"


class NormaliserRegistry:
    """Steps by name; a registry extended by others is a new one."""

    def __init__(self, steps: dict[str, Step] | None = None) -> None:
        self.steps = dict(BUILTIN if steps is None else steps)

    def extended(self, **steps: Step) -> "NormaliserRegistry":
        return NormaliserRegistry(self.steps | steps)

    def compile(self, chain: Sequence[NormaliserStep]) -> Callable[[Column], Column]:
        """One function of the raw text; at most 8 steps, each known."""
        if len(chain) > 8:
            raise ValueError("a chain has at most 8 steps")
        if unknown := [s.name for s in chain if s.name not in self.steps]:
            raise ValueError(f"no step {', '.join(unknown)}")

        def run(value: Column) -> Column:
            for step in chain:
                value = self.steps[step.name](value, **step.args)
            return value

        return run


def _money(value: Column, currency: str | None = None, decimal: str = ".") -> Column:
    found = quantities.parse_money(value, decimal)
    return found["amount"] if currency is None else F.when(found["currency"] == currency, found["amount"])


def _unit(value: Column, source: str, target: str, gallon: str = "uk") -> Column:
    return units.convert(value, F.lit(source), F.lit(target), gallon)


def _whole(value: Column) -> Column:
    """Half up to a whole number."""
    return F.round(value).cast("long")


def _enum(value: Column, options: Sequence[str]) -> Column:
    """The option that equals the text without case or a vocabulary's prefix, or null."""
    bare = F.lower(F.regexp_replace(F.trim(value), r"^.*[/#]", ""))
    return F.element_at(F.create_map(*[F.lit(x) for o in options for x in (o.lower(), o)]), bare)


BUILTIN: dict[str, Step] = {
    "strip": lambda v: text.strip(v),
    "fold": lambda v: text.fold(v),
    "number": lambda v, decimal=".": quantities.parse_number(v, decimal),
    "money": _money,
    "date": lambda v, order="dmy": quantities.parse_date(v, order),
    "range": lambda v, decimal=".": quantities.parse_range(v, decimal),
    "unit": _unit,
    "whole": _whole,
    "enum": _enum,
    "value": lambda v: text.value_after_label(v),
}


def localised(chain: Sequence[NormaliserStep], decimal: str = ".", order: str = "dmy", gallon: str = "uk") -> list[NormaliserStep]:
    """The chain with a locale's arguments where a step takes them, they differ and aren't set."""
    takes = {"number": {"decimal": decimal}, "money": {"decimal": decimal}, "range": {"decimal": decimal}, "date": {"order": order}, "unit": {"gallon": gallon}}
    usual = {"decimal": ".", "order": "dmy", "gallon": "uk"}
    return [NormaliserStep(s.name, {k: v for k, v in takes.get(s.name, {}).items() if v != usual[k]} | s.args) for s in chain]
