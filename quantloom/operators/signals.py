"""How well scores order what follows: information coefficients, buckets, decay, discrimination, attribution."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import EPS, average_rank, guarded_ratio, pearson


def rank_buckets(df: DataFrame, score: str, k: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``bucket`` 1 to ``k`` from the ordinal rank of the score within ``by``; NULL for missing scores and singletons.

    With ``N >= k`` rows bucket sizes differ by one at most; with fewer, the buckets used are spread from 1 to ``k``.
    """
    own = Window.partitionBy(*by, F.col(score).isNotNull())
    r, n = F.row_number().over(own.orderBy(score, *order)), F.count(score).over(own)
    many = F.floor((r - 1) * k / n + EPS) + 1
    few = F.floor((r - 1) * F.lit(k - 1) / F.greatest(n - 1, F.lit(1)) + EPS) + 1
    return df.withColumn("bucket", F.when(F.col(score).isNotNull() & (n > 1), F.when(n >= k, many).otherwise(few)))


def date_diagnostics(df: DataFrame, time: str, score: str, target: str, weight: str | None = None, threshold: float = 0.0, active: float = EPS) -> DataFrame:
    """By date: observations, Pearson and rank correlation of score and target, hit rates (plain and by size of the target)."""
    both = F.col(score).isNotNull() & F.col(target).isNotNull()
    d = df.withColumn("_s", F.when(both, F.col(score))).withColumn("_t", F.when(both, F.col(target)))
    d = d.withColumn("_rs", average_rank(F.col("_s"), [time])).withColumn("_rt", average_rank(F.col("_t"), [time]))
    side = F.col(weight or score)
    on = both & (F.abs(side) > active)
    hit = F.when(on, ((side > 0) == (F.col(target) > threshold)).cast("double"))
    size = F.when(on, F.abs(F.col(target) - threshold))
    return d.groupBy(time).agg(
        F.count("_s").alias("observations"), pearson(F.col("_s"), F.col("_t")).alias("ic"), pearson(F.col("_rs"), F.col("_rt")).alias("rank_ic"),
        F.count(hit).alias("directional_observations"), F.avg(hit).alias("hit_rate"), guarded_ratio(F.sum(hit * size), F.sum(size)).alias("weighted_hit_rate"),
        F.avg("_s").alias("mean_score"), F.avg("_t").alias("mean_target"),
    )


def ic_summary(per_date: DataFrame, column: str = "rank_ic", periods: int | None = 252) -> DataFrame:
    """Mean, median, spread, share above zero and information ratio of a coefficient over dates; annualised with ``periods``."""
    x = F.col(column)
    ir = F.when(F.stddev_samp(x) > EPS, F.avg(x) / F.stddev_samp(x))
    out = per_date.agg(F.count(x).alias("dates"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("std"), F.avg((x > 0).cast("double")).alias("positive_rate"), ir.alias("information_ratio"))
    return out.withColumn("annualized_information_ratio", F.col("information_ratio") * periods**0.5) if periods else out


def ic_basis(per_date: DataFrame) -> str:
    """``cross_sectional`` if any date has both coefficients, else ``rolling_time_series``."""
    found = per_date.agg(F.max((F.col("ic").isNotNull() & F.col("rank_ic").isNotNull()).cast("int")).alias("x")).first()
    return "cross_sectional" if found.x else "rolling_time_series"


def rolling_diagnostics(per_date: DataFrame, time: str, window: int, columns: Sequence[str] = ("ic", "rank_ic", "hit_rate")) -> DataFrame:
    """Rolling mean, spread and ratio over full windows of dates (one row a date)."""
    w = Window.orderBy(time).rowsBetween(-(window - 1), 0)
    new = {}
    for c in columns:
        full = F.count(c).over(w) == window
        new[f"{c}_mean"], new[f"{c}_std"] = F.when(full, F.avg(c).over(w)), F.when(full, F.stddev_samp(c).over(w))
        new[f"{c}_ir"] = guarded_ratio(new[f"{c}_mean"], new[f"{c}_std"])
    return per_date.select(time, *[x.alias(n) for n, x in new.items()])


def rolling_pair_correlation(per_date: DataFrame, time: str, a: str, b: str, window: int) -> DataFrame:
    """Trailing correlation of two date series over full windows: ``pearson`` by covariances, ``spearman`` by ranks within each window."""
    w = Window.orderBy(time).rowsBetween(-(window - 1), 0)
    full = F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).over(w) == window

    @F.pandas_udf("double")
    def spearman(pairs: pd.Series) -> pd.Series:
        def one(rows) -> float | None:
            if len(rows) != window:
                return None
            x, y = (pd.Series([r[k] for r in rows]).rank() for k in ("x", "y"))
            return float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else None

        return pairs.map(one)

    pairs = F.collect_list(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).alias("x"), F.col(b).alias("y")))).over(w)
    d = per_date.withColumn("pearson", F.when(full, pearson(F.col(a), F.col(b), w))).withColumn("_pairs", pairs)
    return d.select(time, "pearson", spearman("_pairs").alias("spearman"))


def shift_target(df: DataFrame, time: str, entity: str, target: str, k: int) -> Column:
    return F.lead(target, k).over(Window.partitionBy(entity).orderBy(time))


def signal_decay(df: DataFrame, time: str, entity: str, score: str, target: str, leads: Sequence[int]) -> DataFrame:
    """For each lead: how many pairs there are, mean coefficients by date, and the pooled correlation.

    All leads come from one window, and all figures from one aggregate by lead and date, so more leads cost no further scan.
    """
    ahead = F.array(*[F.struct(F.lit(k).alias("lead"), shift_target(df, time, entity, target, k).alias("_t")) for k in leads])
    rows = df.select(F.col(time).alias("_d"), F.col(score).cast("double").alias("_s"), ahead.alias("_x")).select("_d", "_s", F.inline("_x"))
    rows = rows.withColumn("_t", F.col("_t").cast("double")).where("_s is not null and _t is not null")
    by = ["lead", "_d"]
    rows = rows.withColumns({"_rs": average_rank(F.col("_s"), by), "_rt": average_rank(F.col("_t"), by)})
    s, t = F.col("_s"), F.col("_t")
    daily = rows.groupBy(*by).agg(
        pearson(s, t).alias("ic"), pearson(F.col("_rs"), F.col("_rt")).alias("rank_ic"), F.count("*").alias("n"), F.avg(s).alias("_ms"), F.avg(t).alias("_mt"),
        F.var_pop(s).alias("_vs"), F.var_pop(t).alias("_vt"), F.covar_pop(s, t).alias("_c"),
    )
    # moments within dates and between them make those of all pairs
    n, total = F.col("n").cast("double"), Window.partitionBy("lead")
    share = n / F.sum(n).over(total)
    ds, dt = (F.col(c) - F.sum(share * F.col(c)).over(total) for c in ("_ms", "_mt"))
    parts = daily.select("lead", "ic", "rank_ic", "n", (share * (F.col("_vs") + ds * ds)).alias("_vs"), (share * (F.col("_vt") + dt * dt)).alias("_vt"), (share * (F.col("_c") + ds * dt)).alias("_c"))
    spread = F.sqrt(F.sum("_vs")) * F.sqrt(F.sum("_vt"))
    found = parts.groupBy("lead").agg(F.sum("n").alias("pairs"), F.when(spread > EPS * EPS, F.try_divide(F.sum("_c"), spread)).alias("pooled"), F.avg("ic").alias("mean_ic"), F.avg("rank_ic").alias("mean_rank_ic"))
    every = df.sparkSession.createDataFrame([(int(k),) for k in dict.fromkeys(leads)], "lead int")
    return every.join(found, "lead", "left").select("lead", F.coalesce("pairs", F.lit(0)).alias("pairs"), "pooled", "mean_ic", "mean_rank_ic")


def signal_buckets(df: DataFrame, score: str, target: str, threshold: float = 0.0) -> DataFrame:
    """By ``bucket``: size, outcomes, hit rate of the score's sign."""
    t = F.col(target)
    hit = F.when(t.isNotNull() & (F.abs(score) > EPS), ((F.col(score) > 0) == (t > threshold)).cast("double"))
    return df.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("size"), F.count(t).alias("outcomes"), F.avg(t).alias("mean"), F.median(t).alias("median"), F.min(t).alias("minimum"), F.max(t).alias("maximum"), F.avg(hit).alias("hit_rate"))


def attribute_buckets(df: DataFrame, time: str, score: str, ret: str, weight: str) -> DataFrame:
    """By ``bucket``: score bounds, counts, total contribution, and its mean over all dates (a day without counts as zero)."""
    c = F.col(weight) * F.coalesce(F.col(ret), F.lit(0.0))
    dates = df.select(time).distinct().agg(F.count("*").alias("_dates"))
    by = df.where("bucket is not null").groupBy("bucket").agg(F.min(score).alias("score_minimum"), F.max(score).alias("score_maximum"), F.count("*").alias("size"), F.avg(ret).alias("mean_return"), F.sum(c).alias("total_contribution"))
    return by.join(F.broadcast(dates)).withColumn("mean_daily_contribution", F.col("total_contribution") / F.col("_dates")).drop("_dates")


def confusion(df: DataFrame, decision: str, target: str, threshold: float = 0.0, active: float = EPS) -> DataFrame:
    on = df.where((F.abs(decision) > active) & F.col(target).isNotNull())
    return on.groupBy((F.col(target) > threshold).alias("actual_up"), (F.col(decision) > 0).alias("predicted_up")).agg(F.count("*").alias("n"))


def _outcomes(df: DataFrame, decision: str, target: str, threshold: float) -> DataFrame:
    """``s, p, n``: how many targets lie above the threshold, and how many don't, for each distinct score."""
    d = df.where(F.col(decision).isNotNull() & F.col(target).isNotNull())
    return d.groupBy(F.col(decision).alias("s")).agg(F.sum((F.col(target) > threshold).cast("long")).alias("p"), F.sum((F.col(target) <= threshold).cast("long")).alias("n"))


#: Ranges that a running sum is cut into at most, and rows of one, about.
MOST_RANGES, ROWS_A_RANGE = 2_000, 200_000


def running(df: DataFrame, by: str, sums: Sequence[str], descending: bool = False, parts: int | None = None) -> DataFrame:
    """``df`` with ``<column>_before`` for each of ``sums``: its total over all rows that come before in the order of ``by``, which is unique.

    Ranges of ``by``, ``parts`` of them or else of about ``ROWS_A_RANGE`` rows and at most ``MOST_RANGES``, cut at approximate quantiles, are summed first; a row adds the rows
    before it in its range, so no task has to order all rows.
    """
    seen = df.agg(F.count("*").alias("n"), F.percentile_approx(by, F.array(*[F.lit(k / MOST_RANGES) for k in range(1, MOST_RANGES)]), F.lit(10 * MOST_RANGES)).alias("cuts")).first()
    parts = parts or min(MOST_RANGES, max(8, seen.n // ROWS_A_RANGE))
    cuts = [seen.cuts[k * MOST_RANGES // parts - 1] for k in range(1, parts)] if seen.cuts else []
    cuts = F.array(*[F.lit(x) for x in sorted(set(cuts))]).cast(f"array<{df.schema[by].dataType.simpleString()}>")
    d = df.withColumn("_range", F.size(F.filter(cuts, lambda x: x <= F.col(by))))
    order = F.desc if descending else F.asc
    ranges = d.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums])
    found = {r._range: r for r in ranges.collect()}  # at most ``MOST_RANGES`` rows
    places = range(parts + 1)[::-1] if descending else range(parts + 1)
    before = {}
    for c in sums:
        total, ahead = 0, [0] * (parts + 1)
        for k in places:
            ahead[k] = total
            total += (found[k][c] or 0) if k in found else 0
        before[c] = F.get(F.array(*map(F.lit, ahead)).cast(f"array<{ranges.schema[c].dataType.simpleString()}>"), F.col("_range"))
    own = Window.partitionBy("_range").orderBy(order(by)).rowsBetween(Window.unboundedPreceding, -1)
    return d.select(*df.columns, *[(before[c] + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(f"{c}_before") for c in sums])


def auc(df: DataFrame, decision: str, target: str, threshold: float = 0.0) -> DataFrame:
    """Area under the ROC curve from counts of each distinct score; NULL with one class."""
    d = running(_outcomes(df, decision, target, threshold), "s", ["n"])
    return d.agg(F.try_divide(F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2.0)), (F.sum("p") * F.sum("n")).cast("double")).alias("roc_auc"))


def roc_points(df: DataFrame, decision: str, target: str, threshold: float = 0.0) -> DataFrame:
    """``score, fpr, tpr`` at each distinct score, from the highest."""
    counts = _outcomes(df, decision, target, threshold)
    total = counts.agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    d = running(counts, "s", ["p", "n"], descending=True).join(F.broadcast(total))  # one row
    return d.select(F.col("s").alias("score"), F.try_divide(F.col("n_before") + F.col("n"), F.col("_n")).alias("fpr"), F.try_divide(F.col("p_before") + F.col("p"), F.col("_p")).alias("tpr"))


def headline(df: DataFrame, time: str, score: str, target: str, k: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """Score moments, pooled correlation, coverage, directional accuracy (dates weigh the same), top minus bottom bucket."""
    b = rank_buckets(df, score, k, [*order, time], [time])
    per = date_diagnostics(df, time, score, target).agg(F.avg("hit_rate").alias("directional_accuracy"))
    ends = b.agg((F.avg(F.when(F.col("bucket") == k, F.col(target))) - F.avg(F.when(F.col("bucket") == 1, F.col(target)))).alias("top_minus_bottom"))
    flat = df.agg(F.avg(score).alias("score_mean"), F.stddev_samp(score).alias("score_std"), pearson(F.col(score), F.col(target)).alias("pooled"), F.avg(F.col(score).isNotNull().cast("double")).alias("coverage"))
    one = [x.withColumn("_k", F.lit(1)) for x in (flat, per, ends)]
    return one[0].join(one[1], "_k").join(one[2], "_k").drop("_k")


def monotonicity(buckets: DataFrame) -> DataFrame:
    """Rank correlation of bucket number and mean outcome."""
    d = buckets.withColumn("_m", average_rank(F.col("mean"), []))
    return d.agg(pearson(F.col("bucket").cast("double"), F.col("_m")).alias("bucket_monotonicity"))


#: Ranges for each doubling of a p-value, of which a correction makes as many as it meets.
RANGES_A_DOUBLING = 1024


def adjust(p_values: DataFrame, p: str = "p_value", how: str = "holm", family: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """``adjusted``: Holm or Benjamini-Hochberg within ``family``; missing values stay and don't count.

    Equal p-values share what the first (Holm) or last of them gets, so ``order``, columns that tell rows of a family apart, only spreads
    the missing ones. Ranks are counted within narrow ranges of p-values and added to the sizes of the ranges before, so no task orders a family.
    """
    if how not in ("holm", "bh"):
        raise ValueError(f"unknown correction {how}")
    holm, there = how == "holm", F.col(p).isNotNull()
    size = F.least(F.greatest(F.col(p).cast("double"), F.lit(1e-300)), F.lit(1e300))
    place = F.when(there, F.floor(F.log2(size) * RANGES_A_DOUBLING)).otherwise(F.lit(2**40) + F.pmod(F.xxhash64(*order) if order else F.lit(0), F.lit(RANGES_A_DOUBLING)))
    rows = p_values.withColumn("_range", place)
    known, keys, line = rows.where(there), [*family, "_range"], Window.partitionBy(*family).orderBy("_range")

    def beside(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
        names = {c: f"_key_{i}" for i, c in enumerate(family)} | {"_range": "_key"}
        on = [F.col(c).eqNullSafe(F.col(n)) if c in family else F.col(c) == F.col(n) for c, n in names.items()]
        return a.join(b.select(*[F.col(c).alias(n) for c, n in names.items()], *columns), on, "left").drop(*names.values())

    up, down = Window.partitionBy(*keys).orderBy(p), Window.partitionBy(*keys).orderBy(F.desc(p))
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    sizes = known.groupBy(*keys).agg(F.count("*").alias("_c"))
    sizes = sizes.select(*keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(*family)).alias("_n"))
    first, last = F.col("_before") + F.rank().over(up), F.col("_before") + F.count("*").over(up)  # of equal values
    factor = F.col(p) * (F.col("_n") - first + 1) if holm else F.col(p) * F.col("_n") / last

    def scaled(d: DataFrame) -> DataFrame:
        return beside(d, sizes, "_before", "_n").withColumn("_x", factor)

    ends = scaled(known).groupBy(*keys).agg((F.max if holm else F.min)("_x").alias("_end"))
    others = before if holm else Window.partitionBy(*family).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, (F.max if holm else F.min)("_end").over(others).alias("_end"))
    d = beside(scaled(rows), ends, "_end")
    within = F.max("_x").over(up) if holm else F.min("_x").over(down)
    adjusted = F.least(F.greatest(within, "_end") if holm else F.least(within, "_end"), F.lit(1.0))
    return d.select(*p_values.columns, F.when(there, adjusted).alias("adjusted"))


def stars(p: Column) -> Column:
    return F.when(p.isNull(), "").when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("(ns)")


def cross_sectional_ranks(df: DataFrame, time: str, columns: Sequence[str]) -> DataFrame:
    """Each column as (rank - 1) / (n - 1) - 0.5 within its date, ties averaged; a lone value becomes 0, a missing one stays."""
    new = {}
    for c in columns:
        n = F.count(c).over(Window.partitionBy(time))
        new[c] = F.when(F.col(c).isNotNull(), F.when(n == 1, 0.0).otherwise((average_rank(F.col(c), [time]) - 1) / F.greatest(n - 1, F.lit(1)) - 0.5))
    return df.withColumns(new)


def ipca_eligibility(df: DataFrame, ret: str, columns: Sequence[str], coverage: float) -> DataFrame:
    """How many rows each test lets through: finite return, any characteristic, enough of them."""
    have = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    a, b, c = F.col(ret).isNotNull(), have > 0, have >= coverage * len(columns)
    return df.agg(F.count("*").alias("input"), F.count_if(~a).alias("missing_return"), F.count_if(a & ~b).alias("no_characteristic"), F.count_if(a & b & ~c).alias("low_coverage"), F.count_if(a & b & c).alias("kept"))


def apply_age_limits(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Blank cells whose ``<column>__age`` is missing, negative or above its limit."""
    return df.withColumns({c: F.when(F.col(f"{c}__age").between(0, k), F.col(c)) for c, k in limits.items()})


def pairs(df: DataFrame, model: str, time: str, value: str) -> DataFrame:
    """``a, b, x, y``: each unordered pair of models on the dates they share."""
    left, right = df.select(F.col(model).alias("a"), time, F.col(value).alias("x")), df.select(F.col(model).alias("b"), time, F.col(value).alias("y"))
    return left.join(right, time).where("a < b")


def return_correlation(df: DataFrame, model: str, time: str, value: str) -> DataFrame:
    return pairs(df, model, time, value).groupBy("a", "b").agg(F.count("*").alias("dates"), pearson(F.col("x"), F.col("y")).alias("correlation"))


def position_overlap(df: DataFrame, model: str, time: str, entity: str, weight: str = "weight") -> DataFrame:
    """Mean daily cosine of two models' weights; an entity that only one holds counts as zero in the other."""
    norm = df.groupBy(model, time).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("_n"))
    a = df.select(F.col(model).alias("a"), time, entity, F.col(weight).alias("x"))
    b = df.select(F.col(model).alias("b"), time, entity, F.col(weight).alias("y"))
    dot = a.join(b, [time, entity]).where("a < b").groupBy("a", "b", time).agg(F.sum(F.col("x") * F.col("y")).alias("_d"))
    days = norm.select(F.col(model).alias("a"), time, F.col("_n").alias("_na")).join(norm.select(F.col(model).alias("b"), time, F.col("_n").alias("_nb")), time).where("a < b")
    cosine = guarded_ratio(F.coalesce("_d", F.lit(0.0)), F.col("_na") * F.col("_nb"))
    return days.join(dot, ["a", "b", time], "left").groupBy("a", "b").agg(F.avg(F.coalesce(cosine, F.lit(0.0))).alias("overlap"))



def evaluate(df: DataFrame, time: str, entity: str, score: str, target: str, k: int = 5, window: int = 63, leads: Sequence[int] = (1, 5, 21), threshold: float = 0.0) -> dict[str, DataFrame]:
    """All tables of a signal's evaluation, by name: coefficients by date, their summary and rolling form, decay, buckets, discrimination, headline."""
    per_date = date_diagnostics(df, time, score, target, threshold=threshold)
    buckets = signal_buckets(rank_buckets(df, score, k, [entity], [time]), score, target, threshold)
    return {
        "dates": per_date, "ic": ic_summary(per_date, "ic"), "rank_ic": ic_summary(per_date, "rank_ic"), "rolling": rolling_diagnostics(per_date, time, window), "decay": signal_decay(df, time, entity, score, target, leads),
        "buckets": buckets, "monotonicity": monotonicity(buckets), "confusion": confusion(df, score, target, threshold), "auc": auc(df, score, target, threshold), "roc": roc_points(df, score, target, threshold),
        "headline": headline(df, time, score, target, k, [entity]),
    }
