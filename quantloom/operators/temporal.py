"""Chronological splits, exponentially weighted standardisation, and sequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..panel import Panel


@dataclass(frozen=True)
class Splitter:
    """Sizes in dates of one block: train, purge, validation, purge, test. ``step`` moves it; None: one block at the end."""

    train: int
    val: int
    test: int
    purge: int = 0
    step: int | None = None

    @property
    def block(self) -> int:
        return self.train + self.val + self.test + 2 * self.purge


def calendar(df: DataFrame, time: str) -> DataFrame:
    """Distinct dates with their number from 0: one row a date, however many rows the panel has."""
    return df.select(time).distinct().withColumn("n", F.row_number().over(Window.orderBy(time)) - 1)


def folds(df: DataFrame, time: str, s: Splitter) -> DataFrame:
    """``fold`` and six inclusive dates; oldest first, the last fold ends on the last date. Empty if the calendar is too short."""
    days = calendar(df, time)
    total = days.agg(F.count("*").alias("total"))
    step = s.step or s.block
    many = F.floor((F.col("total") - s.block) / step) + 1 if s.step else F.lit(1)
    many = F.when(F.col("total") >= s.block, many).otherwise(0).cast("int")
    starts = total.where(F.col("total") >= s.block).select("total", F.explode(F.sequence(F.lit(0), many - 1)).alias("fold"), many.alias("many"))
    starts = starts.withColumn("first", F.col("total") - s.block - (F.col("many") - 1 - F.col("fold")) * step)
    marks = {"train_start": 0, "train_end": s.train - 1, "val_start": s.train + s.purge, "val_end": s.train + s.purge + s.val - 1, "test_start": s.block - s.test, "test_end": s.block - 1}
    long = starts.select("fold", F.explode(F.array(*[F.struct(F.lit(k).alias("mark"), (F.col("first") + v).alias("n")) for k, v in marks.items()])).alias("x")).select("fold", "x.mark", F.col("x.n").cast("int").alias("n"))
    return long.join(days, "n").groupBy("fold").agg(*[F.max(F.when(F.col("mark") == k, F.col(time))).alias(k) for k in marks])


def assign(df: DataFrame, time: str, fold: DataFrame) -> DataFrame:
    """Rows with ``fold`` and ``part``; a row may lie in several folds. The fold table is a few rows and joins by range."""
    part = F.when(F.col(time).between(F.col("train_start"), F.col("train_end")), "train").when(F.col(time).between(F.col("val_start"), F.col("val_end")), "val").when(F.col(time).between(F.col("test_start"), F.col("test_end")), "test")
    inside = df.join(F.broadcast(fold), F.col(time).between(F.col("train_start"), F.col("test_end")))
    return inside.withColumn("part", part).where("part is not null").select("fold", "part", *df.columns)


def window_with_history(df: DataFrame, time: str, start: object, end: object, lookback: int) -> DataFrame:
    """Rows from ``lookback`` dates before ``start`` to ``end``, on the panel's own calendar."""
    days = calendar(df, time)
    first = days.where(F.col(time) >= F.lit(start)).agg((F.min("n") - lookback).alias("_first"))
    keep = days.join(F.broadcast(first)).where((F.col("n") >= F.col("_first")) & (F.col(time) <= F.lit(end))).select(time)
    return df.join(keep, time, "left_semi")


def check_purge(purge: int, label_shift: int) -> None:
    """A label that looks ahead needs as many purged dates."""
    if purge < max(-label_shift, 0):
        raise ValueError(f"purge of {purge} dates is less than the label's horizon of {max(-label_shift, 0)}")


def decay(half_life: float) -> float:
    if half_life <= 0:
        raise ValueError("half-life must be positive")
    return 2 ** (-1 / half_life)


def ewma_prior(train: Panel, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Mean and population variance of each column: by entity, and over all rows for entities not seen."""
    aggs = [x for c in columns for x in (F.avg(c).alias(f"{c}__mean"), F.var_pop(c).alias(f"{c}__var"))]
    return train.df.groupBy(train.require_entity()).agg(*aggs), train.df.agg(*[a.alias(n) for a, n in zip(aggs, [f"_{c}__{k}" for c in columns for k in ("mean", "var")], strict=True)])


def ewma_scores(v: np.ndarray, mean: float, var: float, lam: float, floor: float) -> tuple[np.ndarray, float, float]:
    """(z, mean, variance): each value scored by the state before it, and the state after the last one.

    Between values, mean and variance are sums with powers of ``lam`` as weights; they are taken in blocks so short that no power gets large.
    """
    z, at = np.zeros(len(v)), np.flatnonzero(np.isfinite(v))
    block = max(1, int(18 / -np.log(lam)))
    for low in range(0, len(at), block):
        own = at[low : low + block]
        x, grown = v[own], lam ** -np.arange(1, len(own) + 1, dtype=np.float64)
        means = (mean + (1 - lam) * np.cumsum(grown * x)) / grown
        before = np.append(mean, means[:-1])
        d = x - before
        variances = (var + (1 - lam) * lam * np.cumsum(grown * d * d)) / grown
        z[own] = d / np.sqrt(np.maximum(np.append(var, variances[:-1]), floor))
        mean, var = means[-1], variances[-1]
    return z, mean, var


def ewma_standardise(p: Panel, train: Panel, column: str, half_life: float, floor: float = 1e-12) -> DataFrame:
    """``time, entity, z``: each value against the mean and variance before it, which then decay toward it.

    Missing values score 0 and leave the state alone; entities without a prior start from the pooled one. Rows are read in the
    order of entity and time, batch after batch, with one entity's state at hand, so a history may be of any length. A panel that is
    its own ``train`` is computed and shuffled once: scores and priors read the same shuffle.
    """
    entity, lam = p.require_entity(), decay(half_life)
    rows = p.df.select(F.col(p.time).alias("t"), F.col(entity).alias("e"), F.col(column).cast("double").alias("v"))
    key = F.struct("e")  # never null: a plain key's join would drop null ones first and read a shuffle of its own
    if train is p:
        rows = rows.repartition(key)
        own, pooled = ewma_prior(Panel(rows.sortWithinPartitions("e", "t"), "t", "e"), ["v"])
    else:
        own, pooled = ewma_prior(Panel(train.df.select(F.col(train.require_entity()).alias("e"), F.col(column).alias("v"))), ["v"])
    own = own.select(key.alias("_k"), F.col("e").isNotNull().alias("_known"), "v__mean", "v__var")
    rows = rows.join(own, key == F.col("_k"), "left").join(F.broadcast(pooled))  # pooled is one row
    mean, var = (F.when(F.col("_known"), F.col(c)) for c in ("v__mean", "v__var"))
    rows = rows.select("t", "e", "v", F.coalesce(mean, "_v__mean", F.lit(0.0)).alias("m"), F.coalesce(var, "_v__var", F.lit(0.0)).alias("s"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mean, var = None, 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column("e").dictionary_encode()
            code = np.asarray(name.indices.fill_null(-1))
            v, m, s = (np.asarray(batch.column(c), dtype=np.float64) for c in ("v", "m", "s"))
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            out = []
            for low, high in zip(first, [*first[1:], len(code)], strict=True):
                who = batch.column("e")[int(low)].as_py()
                if last is None or last[0] != who:
                    mean, var, last = m[low], s[low], (who,)
                z, mean, var = ewma_scores(v[low:high], mean, var, lam, floor)
                out.append(z)
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("e"), pa.array(np.concatenate(out))], ["t", "e", "z"])

    kinds = dict(rows.dtypes)
    done = rows.repartition(key).sortWithinPartitions("e", "t").mapInArrow(scored, f"t {kinds['t']}, e {kinds['e']}, z double")
    return done.select(F.col("t").alias(p.time), F.col("e").alias(entity), "z")


def segment_runs(p: Panel, window: int, segment: str = "segment") -> DataFrame:
    """The panel with ``run``: stretches of a segment without a gap in the panel's calendar, of at least ``window`` rows."""
    keys = [p.require_entity(), segment]
    d = p.df.join(calendar(p.df, p.time), p.time)
    w = Window.partitionBy(*keys).orderBy(p.time)
    d = d.withColumn("run", F.col("n") - F.row_number().over(w)).drop("n")
    return d.where(F.lit(True)).withColumn("_size", F.count("*").over(Window.partitionBy(*keys, "run"))).where(F.col("_size") >= window).drop("_size")


def build_sequences(p: Panel, columns: Sequence[str], length: int, buffer: int = 0, segment: str = "segment") -> DataFrame:
    """Keys and ``sequence``: the ``length + buffer`` rows of a run that end at each row, where there are that many."""
    n = length + buffer
    d = segment_runs(p, n, segment)
    w = Window.partitionBy(p.require_entity(), segment, "run").orderBy(p.time).rowsBetween(-(n - 1), 0)
    d = d.withColumn("sequence", F.collect_list(F.struct(*columns)).over(w))
    return d.where(F.size("sequence") == n).select(*p.keys, "sequence")


def buffer_size(kernels: Sequence[tuple[int, int]]) -> int:
    """Rows that a stack of (kernel, padding) layers consumes."""
    return sum(k - 1 - 2 * pad for k, pad in kernels)


def date_batches(df: DataFrame, time: str, size: int) -> DataFrame:
    """``batch``: consecutive blocks of ``size`` dates."""
    return df.join(calendar(df, time).withColumn("batch", F.floor(F.col("n") / size)).drop("n"), time)
