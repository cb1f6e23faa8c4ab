"""Cleaning steps: each takes a panel and returns one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from ..panel import Panel

OPERATORS = {"gt": "__gt__", "ge": "__ge__", "lt": "__lt__", "le": "__le__", "eq": "__eq__", "ne": "__ne__"}


def deduplicate(p: Panel) -> Panel:
    """Rows that share all keys become one, their values averaged without the missing ones. Rows without a key go."""
    kinds = dict(p.df.dtypes)

    def mean(c: str) -> Column:
        if kinds[c] in ("date", "timestamp", "timestamp_ntz"):
            at = F.col(c).cast("timestamp")
            return F.timestamp_micros(F.avg(F.unix_micros(at)).cast("long")).cast(kinds[c]).alias(c)
        return F.avg(c).alias(c) if kinds[c] != "string" else F.min(c).alias(c)

    return p.with_df(p.df.dropna(subset=p.keys).groupBy(*p.keys).agg(*[mean(c) for c in p.values]))


def corporate_adjustment(p: Panel, prices: Sequence[str] = (), price_factor: str | None = None, volume: str | None = None, shares: str | None = None, share_factor: str | None = None) -> Panel:
    """Prices over their factor, volume over the share factor, shares times it. A zero factor gives NULL."""
    if prices and not price_factor:
        raise ValueError("prices need price_factor")
    if (volume or shares) and not share_factor:
        raise ValueError("volume and shares need share_factor")
    p.require(*prices, *[c for c in (price_factor, volume, shares, share_factor) if c])
    new = {c: ratio(F.col(c), F.col(price_factor)) for c in prices}
    if volume:
        new[volume] = ratio(F.col(volume), F.col(share_factor))
    if shares:
        new[shares] = F.col(shares) * F.col(share_factor)
    return p.with_df(p.df.withColumns(new))


#: What a rule may do by name.
HOW = ("left", "operands", "raise")


def refuse(what: str, *problems: str | bool) -> None:
    """An error that tells all problems there are."""
    if told := [p for p in problems if p]:
        raise ValueError(f"{what}: {'; '.join(told)}")


def _names(columns: Sequence[str], role: str) -> str:
    """What is wrong with a list of columns, if anything."""
    if isinstance(columns, str):
        return f"{role} columns come in a tuple, not as {columns!r}"
    again = sorted({c for c in columns if list(columns).count(c) > 1})
    return "" if columns and all(columns) and not again else f"{role} columns are named twice: {again}" if again else f"{role} columns are missing"


@dataclass(frozen=True)
class Constraint:
    """``left`` columns must hold ``operator`` against ``right``, a column's name or a number."""

    left: tuple[str, ...]
    operator: str
    right: str | float

    def __post_init__(self) -> None:
        refuse("constraint", _names(self.left, "left"), self.operator not in OPERATORS and f"operator {self.operator} is none of {', '.join(OPERATORS)}")
        if type(self.right) not in (str, int, float):
            raise TypeError(f"a constraint compares with a column or a number, not with {self.right!r}")

    def columns(self) -> tuple[str, ...]:
        return (*self.left, *([self.right] if isinstance(self.right, str) else []))

    def violated(self, c: str) -> Column:
        """A missing operand is no violation."""
        right = F.col(self.right) if isinstance(self.right, str) else F.lit(float(self.right))
        return ~F.coalesce(getattr(F.col(c), OPERATORS[self.operator])(right), F.lit(True))


@dataclass(frozen=True)
class Rule:
    """``invalidate``: ``left`` (the cell), ``operands`` (all operands of the row), ``raise``, or names of columns."""

    name: str
    constraints: tuple[Constraint, ...]
    invalidate: str | tuple[str, ...] = "left"

    def __post_init__(self) -> None:
        how = self.invalidate
        odd = how not in HOW and f"{how!r} is none of {', '.join(HOW)}; columns come in a tuple" if isinstance(how, str) else _names(how, "invalidated")
        refuse(f"rule {self.name}", not self.name and "it has no name", not self.constraints and "it has no constraint", odd)

    def columns(self) -> set[str]:
        """All columns that it reads or blanks."""
        own = {c for k in self.constraints for c in k.columns()}
        return own if isinstance(self.invalidate, str) else own | set(self.invalidate)

    def masks(self) -> dict[str, Column]:
        """Which cells a row loses; all judged before any is written."""
        out: dict[str, Column] = {}
        for k in self.constraints:
            for c in k.left:
                bad = k.violated(c)
                hit = (c,) if self.invalidate == "left" else (c, *k.columns()[len(k.left) :]) if self.invalidate == "operands" else self.invalidate
                for x in hit:
                    out[x] = out[x] | bad if x in out else bad
        return out

    def any(self) -> Column:
        bad = F.lit(False)
        for k in self.constraints:
            for c in k.left:
                bad = bad | k.violated(c)
        return bad


def consistency_check(p: Panel, rules: Sequence[Rule]) -> Panel:
    """Apply rules one after another, each to what the one before left."""
    p.require(*[c for r in rules for c in r.columns()])
    df = p.df
    for r in rules:
        if r.invalidate == "raise":
            df = df.where(F.when(r.any(), F.raise_error(F.lit(f"rule {r.name} is violated")).cast("boolean")).otherwise(F.lit(True)))
        else:
            df = df.withColumns({c: F.when(~bad, F.col(c)) for c, bad in r.masks().items()})
    return p.with_df(df)


def consistency_report(p: Panel, rules: Sequence[Rule]) -> DataFrame:
    """``rule, violating_rows, invalidated_cells`` in one pass over the panel."""
    p.require(*[c for r in rules for c in r.columns()])
    df, sums = p.df, []
    for i, r in enumerate(rules):
        masks = {} if r.invalidate == "raise" else r.masks()
        cells = sum(((F.col(c).isNotNull() & bad).cast("long") for c, bad in masks.items()), F.lit(0).cast("long"))
        df = df.withColumns({f"_rows{i}": r.any().cast("long"), f"_cells{i}": cells})
        df = df.withColumns({c: F.when(~bad, F.col(c)) for c, bad in masks.items()})
        sums += [F.sum(f"_rows{i}").alias(f"_rows{i}"), F.sum(f"_cells{i}").alias(f"_cells{i}")]
    parts = [F.struct(F.lit(r.name).alias("rule"), F.col(f"_rows{i}").alias("violating_rows"), F.col(f"_cells{i}").alias("invalidated_cells")) for i, r in enumerate(rules)]
    return df.agg(*sums).select(F.inline(F.array(*parts)))


def non_negative_check(p: Panel, columns: Sequence[str]) -> Panel:
    p.require(*columns)
    return p.with_df(p.df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in columns}))


def impute(p: Panel, ffill: Sequence[str] = (), fill_zero: Sequence[str] = (), subgroup_keys: Sequence[str] = ()) -> Panel:
    """Carry values forward within entity and subgroup, put zero elsewhere, drop rows still without any listed column.

    A row without one of its group keys is filled with nothing.
    """
    p.require(*ffill, *fill_zero, *subgroup_keys)
    keys = [*([p.entity] if p.entity else []), *subgroup_keys]
    w = Window.partitionBy(*keys).orderBy(p.time).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    new = {c: F.when(whole, F.last(c, ignorenulls=True).over(w)) for c in ffill}
    new |= {c: F.coalesce(F.col(c), F.lit(0.0)) for c in fill_zero}
    return p.with_df(p.df.withColumns(new).dropna(subset=[*ffill, *fill_zero]))


def missing_threshold_filter(p: Panel, threshold: float, subgroup_keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> Panel:
    """Drop columns (no keys) or whole groups whose worst checked column is missing in more than ``threshold`` of the rows.

    Without keys the rates are one small aggregate, read before the plan goes on; with keys the rates join back,
    one row for each group, so that no group is gathered.
    """
    if not 0 <= threshold < 1:
        raise ValueError("threshold lies in [0, 1)")
    checked = list(columns) if columns else [c for c in p.values if c not in subgroup_keys]
    p.require(*checked, *subgroup_keys)
    rate = {c: F.avg(F.col(c).isNull().cast("double")) for c in checked}
    keys = [*([p.entity] if p.entity else []), *subgroup_keys]
    if not keys:
        found = p.df.agg(*[x.alias(c) for c, x in rate.items()]).first()
        return p.with_df(p.df.drop(*[c for c in checked if found[c] is not None and found[c] > threshold]))
    worst = F.greatest(*rate.values()) if len(rate) > 1 else next(iter(rate.values()))
    good = p.df.dropna(subset=keys).groupBy(*keys).agg(worst.alias("_worst")).where(F.col("_worst") <= threshold).select(*keys)
    return p.with_df(p.df.join(good, keys, "left_semi"))


def calendar_filter(p: Panel, sessions: DataFrame, session: str = "session") -> Panel:
    """Rows whose day is a session of the calendar table."""
    day = F.to_date(F.col(p.time))
    return p.with_df(p.df.join(sessions.select(F.to_date(session).alias("_day")).distinct(), day == F.col("_day"), "left_semi"))


STEPS: dict[str, Callable[..., Panel]] = {f.__name__: f for f in (deduplicate, corporate_adjustment, consistency_check, non_negative_check, impute, missing_threshold_filter, calendar_filter)}


def apply_steps(p: Panel, steps: Sequence[tuple[str, dict]]) -> Panel:
    """Named steps with their options, in the order given."""
    unknown = sorted({n for n, _ in steps} - set(STEPS))
    if unknown:
        raise KeyError(f"unknown steps: {unknown}")
    return p.pipe(*[lambda q, f=STEPS[n], o=o: f(q, **o) for n, o in steps])
