"""An extraction as an immutable list of named stages over a state of tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame

State = dict[str, DataFrame]
Stage = Callable[[State], State]


class Pipeline:
    """Ordered stages; each takes and returns the state, plans only, and an empty state ends the run."""

    def __init__(self, stages: Iterable[tuple[str, Stage]]) -> None:
        self.stages = tuple(stages)
        names = [n for n, _ in self.stages]
        if len(set(names)) < len(names):
            raise ValueError("the names of stages differ")

    def __iter__(self) -> Iterator[str]:
        return iter(n for n, _ in self.stages)

    def _at(self, name: str) -> int:
        for i, (n, _) in enumerate(self.stages):
            if n == name:
                return i
        raise KeyError(name)

    def replace(self, name: str, stage: Stage) -> "Pipeline":
        at = self._at(name)
        return Pipeline([*self.stages[:at], (name, stage), *self.stages[at + 1 :]])

    def insert(self, before: str, name: str, stage: Stage) -> "Pipeline":
        at = self._at(before)
        return Pipeline([*self.stages[:at], (name, stage), *self.stages[at:]])

    def without(self, name: str) -> "Pipeline":
        at = self._at(name)
        return Pipeline([*self.stages[:at], *self.stages[at + 1 :]])

    def run(self, state: State) -> State:
        for _, stage in self.stages:
            if not state:
                break
            state = stage(state)
        return state
