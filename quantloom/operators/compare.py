"""Models beside each other: the window they share, contracts between them, metric tables and pairwise tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guarded_ratio
from . import portfolio, resample, series_tests, signals

#: What models must share for their net returns to be comparable.
ACCOUNTING = ("return_type", "fee", "spread", "slippage", "borrow")


def comparison_window(tests: DataFrame, end: object | None = None) -> tuple:
    """Latest start and earliest end of the models' tests (``start``, ``end``), cut at ``end``."""
    r = tests.agg(F.max("start").alias("s"), F.min("end").alias("e")).first()
    last = min(r.e, end) if end is not None else r.e
    if r.s > last:
        raise ValueError("the models' test windows don't meet")
    return r.s, last


def check_accounting(models: Mapping[str, Mapping]) -> None:
    """Costs and return type must agree; weighting and leverage may differ."""
    for key in ACCOUNTING:
        if len({m[key] for m in models.values()}) > 1:
            raise ValueError(f"models differ in {key}")


def check_realisation_lag(models: Mapping[str, int], lag: int) -> None:
    odd = sorted(n for n, k in models.items() if k != lag)
    if odd:
        raise ValueError(f"models trained with another realisation lag: {odd}")


def long_metrics(metrics: DataFrame, model: str) -> DataFrame:
    """One row of metrics as ``model, metric, value``."""
    names = [c for c, k in metrics.dtypes if k in ("double", "bigint", "int", "float")]
    return metrics.select(F.lit(model).alias("model"), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("x")).select("model", "x.metric", "x.value")


def metric_table(long: DataFrame) -> DataFrame:
    """Models as rows, metrics as columns in order; only for display."""
    return long.groupBy("model").pivot("metric").agg(F.first("value"))


def adjusted(p: np.ndarray, how: str = "holm") -> np.ndarray:
    """Holm or Benjamini-Hochberg on an array; missing values stay and don't count."""
    out, ok = np.full(len(p), np.nan), np.flatnonzero(np.isfinite(p))
    order = ok[np.argsort(p[ok], kind="stable")]
    n = len(order)
    if how == "holm":
        out[order] = np.minimum(1, np.maximum.accumulate(p[order] * (n - np.arange(n))))
    else:
        out[order] = np.minimum(1, np.minimum.accumulate((p[order] * n / (np.arange(n) + 1))[::-1])[::-1])
    return out


def diebold_mariano_pairs(daily: DataFrame, model: str, time: str, ret: str = "net_return", how: str = "holm", lag: int | None = None) -> DataFrame:
    """``a, b, p_value, adjusted`` of each pair of models by their losses, minus the net return, on the dates that both have."""
    tests = series_tests.diebold_mariano(daily.select(model, time, (-F.col(ret)).alias("_loss")), model, time, "_loss", lag=lag)
    return signals.adjust(tests.select("a", "b", "p_value"), "p_value", how, order=["a", "b"])


def sharpe_pairs(daily: DataFrame, model: str, time: str, excess: str = "excess_return", how: str = "holm", times: int = 500, block: float = 10, seed: int = 42) -> DataFrame:
    """``a, b, p_value, adjusted`` of each pair of models: are their Sharpe ratios equal, by the paired bootstrap?"""
    tests = resample.sharpe_differences(daily, model, time, excess, times=times, block=block, seed=seed)
    return signals.adjust(tests.select("a", "b", F.col("bootstrap_p_value").alias("p_value")), "p_value", how, order=["a", "b"])


def confidence_set(daily: DataFrame, model: str, time: str, ret: str = "net_return", alpha: float = 0.1, times: int = 500, block: float = 10, seed: int = 42) -> DataFrame:
    """``model, mcs_p_value, in_confidence_set, mean_loss`` by loss, minus the net return, on shared dates."""
    return resample.confidence_set(daily.select(model, time, (-F.col(ret)).alias("_loss")), [], model, time, "_loss", alpha, times, block, seed)


def period_summary(daily: DataFrame, time: str) -> DataFrame:
    """Share of positive months and years, best and worst, before and after costs."""
    parts = []
    for period in ("month", "year"):
        for kind in ("gross", "net"):
            p = portfolio.period_returns(daily, time, period, f"{kind}_return")
            parts.append(p.agg(F.lit(period).alias("period"), F.lit(kind).alias("kind"), F.avg((F.col("period_return") > 0).cast("double")).alias("positive_rate"), F.max("period_return").alias("best"), F.min("period_return").alias("worst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contribution_concentration(assets: DataFrame, tops: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Share of absolute contribution in the largest assets, and its Herfindahl index, for return and risk.

    Sums run over all assets; only the largest ``max(tops)`` are ordered.
    """
    out = None
    for kind, column in (("return", "total_contribution"), ("risk", "risk_share")):
        d = assets.select(F.abs(F.coalesce(F.col(column), F.lit(0.0))).alias("_a"))
        whole = d.agg(F.sum("_a").alias("_sum"), F.sum(F.col("_a") * F.col("_a")).alias("_squares"))
        largest = d.orderBy(F.desc("_a")).limit(max(tops)).agg(F.sort_array(F.collect_list("_a"), asc=False).alias("_top"))
        part = lambda k: F.aggregate(F.slice("_top", 1, k), F.lit(0.0), lambda x, y: x + y)
        one = whole.crossJoin(largest)  # a row each
        one = one.select(F.lit(kind).alias("kind"), guarded_ratio(F.col("_squares"), F.col("_sum") * F.col("_sum")).alias("hhi"), *[guarded_ratio(part(k), F.col("_sum")).alias(f"top{k}_share") for k in tops])
        out = one if out is None else out.unionByName(one)
    return out


def signal_correlation(scores: DataFrame, model: str, time: str, entity: str, score: str = "score") -> DataFrame:
    """Rank correlation of two models' scores over the items that both have."""
    from ..functions import average_rank, pearson

    left, right = scores.select(F.col(model).alias("a"), time, entity, F.col(score).alias("x")), scores.select(F.col(model).alias("b"), time, entity, F.col(score).alias("y"))
    both = left.join(right, [time, entity]).where("a < b and x is not null and y is not null")
    both = both.withColumn("_rx", average_rank(F.col("x"), ["a", "b"])).withColumn("_ry", average_rank(F.col("y"), ["a", "b"]))
    return both.groupBy("a", "b").agg(F.count("*").alias("items"), pearson(F.col("_rx"), F.col("_ry")).alias("correlation"))


def publication_table(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named metrics with a readable title, in long form."""
    return long.where(F.col("metric").isin(*names)).withColumn("title", F.initcap(F.regexp_replace("metric", "_", " ")))


def with_stars(tests: DataFrame, value: str, p: str) -> DataFrame:
    return tests.withColumn("cell", F.concat(F.format_string("%.4f", F.col(value)), signals.stars(F.col(p))))
