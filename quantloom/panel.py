"""A panel: rows keyed by time, or by time and entity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql.window import WindowSpec


@dataclass(frozen=True)
class Panel:
    """``df`` with the names of its time, its entity (None for date-only context) and further key columns."""

    df: DataFrame
    time: str = "d"
    entity: str | None = "e"
    extra_keys: tuple[str, ...] = ()

    @property
    def keys(self) -> list[str]:
        return [self.time, *([self.entity] if self.entity else []), *self.extra_keys]

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.keys]

    def with_df(self, df: DataFrame) -> Panel:
        return replace(self, df=df)

    def require(self, *columns: str) -> Panel:
        """Fail before anything is planned if a column isn't there."""
        missing = sorted(set(columns) - set(self.df.columns))
        if missing:
            raise KeyError(f"columns not in the panel: {missing}")
        return self

    def require_entity(self) -> str:
        if not self.entity:
            raise ValueError("the operation needs an entity; this panel has dates only")
        return self.entity

    def by_entity(self) -> WindowSpec:
        """One entity's rows in time order; a date-only panel is one series."""
        return Window.partitionBy(*([self.entity] if self.entity else [])).orderBy(self.time)

    def trailing(self, n: int) -> WindowSpec:
        return self.by_entity().rowsBetween(-(n - 1), 0)

    def by_time(self) -> WindowSpec:
        return Window.partitionBy(self.time)

    def pipe(self, *steps: Callable[[Panel], Panel]) -> Panel:
        """Apply steps in their order."""
        return reduce(lambda p, step: step(p), steps, self)

    def between(self, start: object, end: object) -> Panel:
        """Rows from ``start`` to ``end``, both included."""
        return self.with_df(self.df.where(self.df[self.time].between(start, end)))

    def only(self, entity: object) -> Panel:
        return self.with_df(self.df.where(self.df[self.require_entity()] == entity))
