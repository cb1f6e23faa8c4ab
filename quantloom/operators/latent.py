"""Instrumented principal components: returns on factors whose loadings are linear in characteristics.

Spark reduces the panel to cross products a date. Factors of a date, and the normal equations of the loadings, are made
in tasks from these; the driver holds the loadings and sums as large as their square, never a date.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..sources.durable import discard, written
from .align import align_risk_free
from .signals import apply_age_limits, cross_sectional_ranks

#: Relative size from which a direction counts as one.
TOLERANCE = 1e-7
QUANTILES = (0.0, 0.05, 0.5, 0.95, 1.0)
#: Sums that reach the driver at once.
PARTS = 16


@dataclass
class Factors:
    """``loadings`` (instruments in ``used`` by factors), ``factors`` (a row a date: ``time, n, factors``), and how the sample came about."""

    loadings: np.ndarray
    factors: DataFrame
    used: list[str]
    audit: dict


def prepare_panel(aligned: DataFrame, time: str, entity: str, ret: str, observed: str, columns: Sequence[str], start: object, end: object, return_type: str = "simple", risk_free: DataFrame | None = None) -> DataFrame:
    """Rows of an aligned panel between two dates as the estimation reads them: ``time, entity, ret``, characteristics and their ``__age``.

    A return counts where it was observed on that very date and is finite; carried or broken ones become null, the row stays. Log returns
    become simple ones first; ``risk_free`` (``time, rf``), carried forward, is then taken off. No rows in the window is an error.
    """
    if not columns:
        raise ValueError("no characteristics")
    if return_type not in ("simple", "log"):
        raise ValueError(f"unknown return type {return_type}")
    ages = [f"{c}__age" for c in columns if f"{c}__age" in aligned.columns]
    rows = aligned.where(F.col(time).between(F.lit(start), F.lit(end)))
    if rows.isEmpty():
        raise ValueError("no rows in the window")
    value = F.when(F.coalesce(F.col(observed).cast("boolean"), F.lit(False)), finite(F.col(ret).cast("double")))
    value = F.expm1(value) if return_type == "log" else value
    rows = rows.select(time, entity, value.alias(ret), *[finite(F.col(c).cast("double")).alias(c) for c in columns], *ages)
    if risk_free is not None:
        rates = align_risk_free(rows.select(time), risk_free, time).withColumnRenamed("rf", "_rf")
        rows = rows.join(rates, time).withColumn(ret, F.col(ret) - F.col("_rf")).drop("_rf")
    return rows.withColumn(ret, finite(F.col(ret)))


def panel_audit(panel: DataFrame, time: str, entity: str, ret: str, columns: Sequence[str]) -> DataFrame:
    """One row on a prepared panel: rows, usable and rejected returns, entities, share of each characteristic that is there, and how much of a row is, by date."""
    have = sum((F.col(c).isNotNull().cast("double") for c in columns), F.lit(0.0)) / len(columns)
    daily = panel.groupBy(time).agg(F.avg(have).alias("x")).agg(F.percentile("x", F.array(*map(F.lit, QUANTILES))).alias("daily_coverage"))
    whole = panel.agg(
        F.count("*").alias("grid_rows"), F.count(ret).alias("observed_returns"), F.count_if(F.col(ret).isNull()).alias("rejected_returns"), F.countDistinct(entity).alias("entities"),
        F.create_map(*[x for c in columns for x in (F.lit(c), F.avg(F.col(c).isNotNull().cast("double")))]).alias("non_missing"),
    )
    return whole.crossJoin(daily)  # a row each


def age_limits(columns: Sequence[str], declared: int | Mapping | None) -> dict[str, int]:
    """Highest age by characteristic: one for all, one for some, or ``default`` with exceptions in ``columns``."""
    if declared is None:
        return {}
    if not isinstance(declared, Mapping):
        declared = {"default": declared}
    if set(declared) & {"default", "columns"}:
        if odd := set(declared) - {"default", "columns"}:
            raise ValueError(f"beside default and columns: {sorted(map(str, odd))}")
        own = declared.get("columns", {})
        if not isinstance(own, Mapping):
            raise ValueError("age limits of columns have to be a mapping")
        found = ({} if declared.get("default") is None else dict.fromkeys(columns, declared["default"])) | dict(own)
    else:
        found = dict(declared)
    if odd := set(found) - set(columns):
        raise ValueError(f"age limits for unknown characteristics: {sorted(map(str, odd))}")
    for c, k in found.items():
        if isinstance(k, bool) or not isinstance(k, (int, np.integer)) or k < 0:
            raise ValueError(f"age limit of {c} has to be a whole number of 0 or more")
    return {c: int(k) for c, k in found.items()}


def moments(df: DataFrame, time: str, ret: str, columns: Sequence[str]) -> DataFrame:
    """``time, n, m`` for each date: its rows, and the cross products of characteristics with themselves and with returns, as packed doubles.

    Each task adds up what it has of a date first, so a date may lie in many tasks.
    """
    p = len(columns)
    schema = f"`{time}` {df.schema[time].dataType.simpleString()}, n bigint, m binary"

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(c), np.float64) for c in [*columns, ret]])
            dates = batch.column(0).dictionary_encode()
            code = np.asarray(dates.indices)
            order = np.argsort(code, kind="stable")
            cut = np.searchsorted(code[order], np.arange(len(dates.dictionary) + 1))
            out = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                z, r = x[order[a:b], :p], x[order[a:b], p]
                out.append(np.concatenate([(z.T @ z).ravel(), z.T @ r]).tobytes())
            yield pa.RecordBatch.from_arrays([dates.dictionary, pa.array(np.diff(cut)), pa.array(out, pa.binary())], [time, "n", "m"])

    def add(date: pa.Table) -> pa.Table:
        m = sum(np.frombuffer(x, np.float64) for x in date["m"].to_pylist())
        return pa.table({time: date[time][:1], "n": pa.array([sum(date["n"].to_pylist())], pa.int64()), "m": pa.array([m.tobytes()], pa.binary())})

    return df.select(time, *columns, ret).mapInArrow(cross, schema).groupBy(time).applyInArrow(add, schema)


def total(rows: DataFrame, width: int, of: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over dates (``n``, ``m``) of the ``width`` numbers that ``of`` makes of each: added in tasks, then in a few, and last here."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(width)
        for batch in batches:
            for n, m in zip(batch.column("n").to_pylist(), batch.column("m").to_pylist(), strict=True):
                found += of(n, np.frombuffer(m, np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["m"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(width)
        for batch in batches:
            for m in batch.column("m").to_pylist():
                found += np.frombuffer(m, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["m"])

    parts = rows.select("n", "m").mapInArrow(one, "m binary")
    if rows.rdd.getNumPartitions() > PARTS:
        parts = parts.repartition(PARTS).mapInArrow(more, "m binary")
    return sum((np.frombuffer(r.m, np.float64) for r in parts.collect()), np.zeros(width))


def rank(gram: np.ndarray) -> int:
    """Of a matrix whose cross product is given."""
    s = np.linalg.eigvalsh(gram)
    return int((s > TOLERANCE**2 * s[-1]).sum()) if len(s) and s[-1] > TOLERANCE**2 else 0


def independent(gram: np.ndarray, names: Sequence[str]) -> tuple[list[int], dict[str, str]]:
    """Characteristics, in order, that add a direction to a constant (the last row) and those before them; and why others don't."""
    last, kept, gone = len(gram) - 1, [], {}
    n = gram[last, last]
    for i, c in enumerate(names):
        if n <= 0 or gram[i, i] / n - (gram[i, last] / n) ** 2 <= TOLERANCE**2:
            gone[c] = "does not vary"
        elif rank(gram[np.ix_([last, *kept, i], [last, *kept, i])]) <= len(kept) + 1:
            gone[c] = "follows from others"
        else:
            kept.append(i)
    return kept, gone


def _directions(p: int, used: Sequence[int]) -> Callable[[str], object]:
    """The rank of a date's instruments, from its cross products."""
    at = np.ix_(used, used)

    @F.arrow_udf("int")
    def directions(m: pa.Array) -> pa.Array:
        return pa.array([rank(np.frombuffer(x, np.float64)[: p * p].reshape(p, p)[at]) for x in m.to_pylist()], pa.int32())

    return directions


def estimate(df: DataFrame, time: str, entity: str, ret: str, columns: Sequence[str], k: int, coverage: float = 0.5, max_age: int | Mapping | None = None, rounds: int = 500, tolerance: float = 1e-8) -> Factors:
    """``k`` factors by alternating least squares.

    Rows without a finite return, without any characteristic or with a share under ``coverage`` go; stale characteristics (``<column>__age``
    against ``max_age``) count as missing. Characteristics are ranked within dates and missing ranks are neutral. Dates with ``k`` rows or
    fewer go, as do those whose instruments, with a constant, have fewer than ``k`` directions. ``k`` is never lowered: too little is an error.
    """
    if not columns or len(set(columns)) < len(columns):
        raise ValueError("characteristics have to be there and differ in name")
    limits = age_limits(columns, max_age)
    if missing := [c for c in limits if f"{c}__age" not in df.columns]:
        raise ValueError(f"no age of {missing}")
    if not df.groupBy(time, entity).count().where("count > 1").isEmpty():
        raise ValueError("an entity has more than one row on a date")
    fresh = df.select(time, entity, finite(F.col(ret).cast("double")).alias(ret), *[finite(F.col(c).cast("double")).alias(c) for c in columns], *[f"{c}__age" for c in limits])
    capped = apply_age_limits(fresh, limits)
    stale = fresh.agg(*[F.count_if(F.col(c).isNotNull() & ~F.coalesce(F.col(f"{c}__age").between(0, a), F.lit(False))).alias(c) for c, a in limits.items()]).first() if limits else None
    have = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    there, any_, enough = F.col(ret).isNotNull(), have > 0, have >= coverage * len(columns)
    seen = capped.agg(
        F.count("*").alias("rows"), F.countDistinct(time).alias("dates"), F.count_if(there).alias("with_return"), F.count_if(there & ~any_).alias("bare"), F.count_if(there & any_ & ~enough).alias("sparse"), F.count_if(there & any_ & enough).alias("good"),
        *[F.count(c).alias(f"seen_{i}") for i, c in enumerate(columns)], *[F.count_if(there & any_ & enough & F.col(c).isNull()).alias(f"neutral_{i}") for i, c in enumerate(columns)],
    ).first()
    if not seen.good:
        raise ValueError("no row has a return and enough characteristics")
    ranked = cross_sectional_ranks(capped.where(there & any_ & enough), time, columns).fillna(0.0, subset=list(columns)).withColumn("_constant", F.lit(1.0))
    p = len(columns) + 1
    found = written(moments(ranked, time, ret, [*columns, "_constant"]), "date-moments")
    thin = found.where(F.col("n") <= k).agg(F.count("*").alias("dates"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    alive, dropped, lost, lost_rows = found.where(F.col("n") > k), {}, 0, 0
    while True:
        gram = total(alive, p * p, lambda n, m: m[: p * p]).reshape(p, p)
        if gram[-1, -1] <= 0:
            raise ValueError(f"no date has the rows and the instruments for {k} factors")
        kept, dropped = independent(gram, columns)
        if not kept or k > len(kept) + 1:
            raise ValueError(f"{k} factors from {len(kept)} characteristics and a constant; left out: {dropped}")
        used = [*kept, p - 1]

        flagged = alive.withColumn("_rank", _directions(p, used)("m"))
        poor = flagged.where(F.col("_rank") < k).agg(F.count("*").alias("dates"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        if not poor.dates:
            break
        lost, lost_rows = lost + poor.dates, lost_rows + poor.rows
        alive = written(flagged.where(F.col("_rank") >= k).drop("_rank"), "date-moments")
    q = len(used)
    at = np.ix_(used, used)

    def parts(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return m[: p * p].reshape(p, p)[at], m[p * p :][used]

    def factor(gamma: np.ndarray, m: np.ndarray) -> np.ndarray:
        a, b = parts(m)
        return np.linalg.pinv(gamma.T @ a @ gamma) @ gamma.T @ b

    def equations(gamma: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
        def of(n: int, m: np.ndarray) -> np.ndarray:
            (a, b), f = parts(m), factor(gamma, m)
            ff = np.outer(f, f)
            return np.concatenate([np.kron(a, ff).ravel(), np.kron(b, f), ff.ravel()])

        return of

    start = total(alive, q * q, lambda n, m: np.outer(parts(m)[1], parts(m)[1]).ravel()).reshape(q, q)
    gamma = np.linalg.svd(start)[0][:, :k]
    for done in range(1, rounds + 1):
        sums = total(alive, (q * k) ** 2 + q * k + k * k, equations(gamma))
        left, right, ff = np.split(sums, [(q * k) ** 2, (q * k) ** 2 + q * k])
        after = (np.linalg.pinv(left.reshape(q * k, q * k)) @ right).reshape(q, k)
        # orthonormal loadings, uncorrelated factors, in order of their size
        turn, r = np.linalg.qr(after)
        after = turn @ np.linalg.eigh(r @ ff.reshape(k, k) @ r.T)[1][:, ::-1]
        after *= np.where(after.sum(axis=0) < 0, -1, 1)
        close = np.abs(after @ after.T - gamma @ gamma.T).max() < tolerance
        gamma = after
        if close:
            break

    @F.arrow_udf("array<double>")
    def realised(m: pa.Array) -> pa.Array:
        return pa.array([factor(gamma, np.frombuffer(x, np.float64)) for x in m.to_pylist()], pa.list_(pa.float64()))

    factors = written(alive.select(time, "n", realised("m").alias("factors")), "factors")
    size = factors.agg(F.count("*").alias("dates"), F.sum("n").alias("rows")).first()
    discard(found, *([alive] if hasattr(alive, "_written_path") else []))
    audit = {
        "min_coverage": coverage, "requested_factors": k, "estimated_factors": k, "input_rows": seen.rows, "input_dates": seen.dates, "finite_returns": seen.with_return, "missing_return": seen.rows - seen.with_return,
        "no_characteristic": seen.bare, "low_coverage": seen.sparse, "thin_date_rows": thin.rows, "thin_dates": thin.dates, "rank_deficient_rows": lost_rows, "rank_deficient_dates": lost, "estimation_rows": size.rows, "estimation_dates": size.dates,
        "configured": list(columns), "used": [columns[i] for i in kept], "left_out": dropped, "observations": {c: seen[f"seen_{i}"] for i, c in enumerate(columns)}, "neutral": {c: seen[f"neutral_{i}"] for i, c in enumerate(columns)},
        "stale": {c: stale[c] if c in limits else 0 for c in columns}, "max_age": limits, "rounds": done,
    }
    return Factors(gamma, factors, [*audit["used"], "constant"], audit)
