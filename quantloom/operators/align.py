"""Point-in-time alignment: as-of joins, activity spells, segments, observation flags and ages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..panel import Panel


def asof(grid: DataFrame, source: DataFrame, time: str, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """``grid`` with each column of ``source`` as of the row's time, and ``<column>__source``, the time it comes from.

    Every column is carried by itself: the last value that isn't missing at or before the row's time. Of source rows with
    equal times the last in value order wins. One union, one sort: all columns share a window.
    """
    columns = list(columns or [c for c in source.columns if c not in (time, *by)])
    left = grid.withColumn("_side", F.lit(1)).withColumns({f"_{c}": F.lit(None).cast(source.schema[c].dataType) for c in columns})
    right = source.select(time, *by, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(0).alias("_side"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(time, "_side", *[f"_{c}" for c in columns]).rowsBetween(Window.unboundedPreceding, 0)
    new = {}
    for c in columns:
        new[c] = F.last(f"_{c}", ignorenulls=True).over(w)
        new[f"{c}__source"] = F.last(F.when(F.col(f"_{c}").isNotNull(), F.col(time)), ignorenulls=True).over(w)
    return both.select("*", *[x.alias(c) for c, x in new.items()]).where("_side = 1").drop("_side", *[f"_{c}" for c in columns])


def active_grid(p: Panel, spells: Sequence[tuple[str, str]] = ()) -> Panel:
    """Rows inside every (start, end) pair whose columns are there, both ends included; a missing bound is outside."""
    pairs = [(a, b) for a, b in spells if a in p.df.columns and b in p.df.columns]
    inside = reduce(lambda x, y: x & y, [F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(p.time).between(F.col(a), F.col(b)) for a, b in pairs], F.lit(True))
    return p.with_df(p.df.where(inside))


def segments(p: Panel, spells: Sequence[tuple[str, str]] = ()) -> Panel:
    """``segment``: counts, within an entity, the stretches in which no spell bound changes; ``segment_start``: its first time."""
    w = p.by_entity()
    bounds = [c for pair in spells for c in pair if c in p.df.columns]
    changed = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in bounds], F.lit(False))
    keys = [p.entity] if p.entity else []
    df = p.df.withColumn("_new", F.when(F.row_number().over(w) == 1, 0).otherwise(changed.cast("int")))
    df = df.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return p.with_df(df.withColumn("segment_start", F.min(p.time).over(Window.partitionBy(*keys, "segment"))))


def observed_and_age(p: Panel, columns: Sequence[str]) -> Panel:
    """``<c>__observed``: the value's source time is new in the segment; ``<c>__age``: rows since then, -1 before the first."""
    keys = [*([p.entity] if p.entity else []), "segment"]
    w = Window.partitionBy(*keys).orderBy(p.time)
    df = p.df.withColumn("_at", F.row_number().over(w))
    df = df.withColumns({f"{c}__observed": F.col(f"{c}__source").isNotNull() & ~F.col(f"{c}__source").eqNullSafe(F.lag(f"{c}__source").over(w)) for c in columns})
    last = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"{c}__age": F.coalesce(F.col("_at") - F.last(F.when(F.col(f"{c}__observed"), F.col("_at")), ignorenulls=True).over(last), F.lit(-1)) for c in columns})
    return p.with_df(df.drop("_at"))


def align_and_mask(primary: Panel, sources: Sequence[Panel], spells: Sequence[tuple[str, str]] = ()) -> Panel:
    """All sources on the primary's active grid: values, ``__source``, ``__observed``, ``__age`` and ``segment``.

    A value from before its segment is missing. Date-only sources are carried on the distinct dates first and then joined
    by date, which keeps the window off the full grid.
    """
    grid = segments(active_grid(primary, spells), spells)
    df, names = grid.df, []
    for s in sources:
        names += s.values
        if s.entity:
            df = asof(df, s.df.withColumnsRenamed({s.time: primary.time, s.entity: primary.require_entity()}), primary.time, [primary.entity])
        else:
            dates = asof(df.select(primary.time).distinct(), s.df.withColumnRenamed(s.time, primary.time), primary.time)
            df = df.join(dates, primary.time)
    fence = {}
    for c in names:
        inside = F.col(f"{c}__source") >= F.col("segment_start")
        fence |= {c: F.when(inside, F.col(c)), f"{c}__source": F.when(inside, F.col(f"{c}__source"))}
    return observed_and_age(grid.with_df(df.withColumns(fence)), names)


def align_risk_free(dates: DataFrame, rates: DataFrame, time: str, rate: str = "rf") -> DataFrame:
    """Rates carried forward onto dates, never from the future. Duplicate or non-finite rates, or a date before the first, raise."""
    bad = rates.groupBy(time).agg(F.count("*").alias("n"), F.max(F.col(rate).isNull() | F.isnan(rate) | (F.abs(rate) == float("inf"))).alias("b")).where("n > 1 or b")
    if not bad.isEmpty():
        raise ValueError("risk-free rates must be unique by date and finite")
    out = asof(dates.select(time).distinct(), rates.select(time, rate), time)
    if not out.where(F.col(rate).isNull()).isEmpty():
        raise ValueError("no risk-free rate at or before the first date")
    return out.select(time, rate)


def left_reindex(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left")


def strict_concat(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns side by side; names may not repeat, and both must have the same keys."""
    again = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if again:
        raise ValueError(f"columns on both sides: {again}")
    odd = left.select(*keys).withColumn("_n", F.lit(1)).unionByName(right.select(*keys).withColumn("_n", F.lit(-1))).groupBy(*keys).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    if not odd.isEmpty():
        raise ValueError("keys differ")
    return left.join(right, list(keys))


def common_items(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys that all frames have."""
    return reduce(lambda a, b: a.join(b.select(*keys).distinct(), list(keys), "left_semi"), frames[1:], frames[0].select(*keys).distinct())


def target_disagreement(a: DataFrame, b: DataFrame, keys: Sequence[str], target: str, rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """Common keys on which the targets differ beyond the tolerance."""
    j = a.select(*keys, F.col(target).alias("x")).join(b.select(*keys, F.col(target).alias("y")), list(keys))
    return j.where(F.abs(F.col("x") - F.col("y")) > atol + rtol * F.abs(F.col("y")))


def dense_grid(df: DataFrame, time: str, entity: str) -> DataFrame:
    """Every entity on every date, long: each entity gets the list of dates, so nothing is crossed."""
    dates = df.select(time).distinct().agg(F.sort_array(F.collect_list(time)).alias("_dates"))
    entities = df.select(entity).distinct().withColumn("_k", F.lit(1)).join(F.broadcast(dates.withColumn("_k", F.lit(1))), "_k")
    return entities.select(F.explode("_dates").alias(time), entity).join(df, [time, entity], "left")
