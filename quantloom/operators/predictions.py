"""Predictions as rows: what they must satisfy, which labels count, and how they meet their targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import EPS
from .align import common_items, target_disagreement

KINDS = ("portfolio", "regression", "binary", "multiclass")


def prediction_errors(df: DataFrame, keys: Sequence[str], kind: str, score: str = "score", probabilities: str | None = None, quantiles: str | None = None) -> DataFrame:
    """``repeated, not_finite, bad_probabilities, bad_quantiles``: how many rows break the contract, in one pass and one count of keys.

    ``probabilities`` is a map that sums to one with values in [0, 1]; ``quantiles`` a map from level to value that never falls.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    none = F.lit(False)
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    bad_p = none
    if probabilities:
        p = F.map_values(probabilities)
        total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
        bad_p = ~F.coalesce(F.forall(p, lambda x: x.between(0, 1)) & (F.abs(total - 1) < 1e-6), F.lit(False))
    bad_q = none
    if quantiles:
        q = F.transform(F.array_sort(F.map_entries(quantiles)), lambda x: x["value"])
        bad_q = F.coalesce(F.exists(F.zip_with(q, F.slice(q, 2, F.greatest(F.size(q) - 1, F.lit(1))), lambda a, b: F.coalesce(a > b, F.lit(False))), lambda x: x), F.lit(True))
    rows = df.agg(F.count_if(~F.coalesce(finite, F.lit(False))).alias("not_finite"), F.count_if(bad_p).alias("bad_probabilities"), F.count_if(bad_q).alias("bad_quantiles"))
    repeated = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated"))
    return repeated.join(F.broadcast(rows))


def valid_supervision(label: str, observed: str | None = None) -> Column:
    """The label is there and finite, and was observed on the row's own date."""
    ok = F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")) & (F.abs(F.col(label).cast("double")) < float("inf"))
    return F.coalesce(ok & F.col(observed) if observed else ok, F.lit(False))


def aligned_target(predictions: DataFrame, supervision: DataFrame, keys: Sequence[str], label: str, observed: str | None = None) -> DataFrame:
    """Every prediction with its label; labels that don't count are missing."""
    s = supervision.where(valid_supervision(label, observed)).select(*keys, label)
    return predictions.join(s, list(keys), "left")


def evaluated_sample(predictions: DataFrame, supervision: DataFrame, keys: Sequence[str], label: str, observed: str | None = None) -> DataFrame:
    """Predictions whose label counts, with it: what an evaluation runs on. None at all is an error, and so is a key with two labels."""
    s = supervision.where(valid_supervision(label, observed)).select(*keys, label)
    if not s.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("a key has more than one label")
    out = predictions.join(s, list(keys))
    if out.isEmpty():
        raise ValueError("no prediction has a label that counts")
    return out


def common_sample(candidates: Sequence[DataFrame], keys: Sequence[str], target: str) -> DataFrame:
    """Keys that every candidate predicts with a valid target; targets must agree wherever they meet."""
    first, *others = candidates
    for c in others:
        if not target_disagreement(first, c, keys, target).isEmpty():
            raise ValueError("candidates disagree on targets")
    return common_items([c.where(valid_supervision(target)) for c in candidates], keys)


def same_observations(reference: DataFrame, candidate: DataFrame, keys: Sequence[str]) -> bool:
    """Did a candidate score exactly the rows that the baseline scored?"""
    a, b = reference.select(*keys), candidate.select(*keys)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def objective_panel(df: DataFrame, time: str, score: str = "score", ret: str = "ret") -> DataFrame:
    """Rows of dates with any jointly observed entity; ``valid`` marks the cells, the others hold zero."""
    ok = F.col(score).isNotNull() & F.col(ret).isNotNull()
    d = df.withColumn("valid", ok).where(F.lit(True))
    d = d.withColumn("_n", F.count_if(F.col("valid")).over(Window.partitionBy(time))).where("_n > 0").drop("_n")
    return d.withColumns({c: F.when(F.col("valid"), F.col(c)).otherwise(0.0) for c in (score, ret)})


def prediction_metrics(df: DataFrame, prediction: str, target: str, kind: str) -> DataFrame:
    """Errors of a regression, or accuracy and rates of a binary decision at zero."""
    d = df.where(F.col(prediction).isNotNull() & F.col(target).isNotNull())
    if kind == "regression":
        e = F.col(prediction) - F.col(target)
        ss = F.sum(e * e)
        return d.agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.when(F.var_pop(target) > EPS, 1 - ss / (F.var_pop(target) * F.count("*"))).alias("r_squared"))
    up, said = F.col(target) > 0, F.col(prediction) > 0
    return d.agg(F.count("*").alias("n"), F.avg((up == said).cast("double")).alias("accuracy"), F.try_divide(F.count_if(up & said), F.count_if(up)).alias("true_positive_rate"), F.try_divide(F.count_if(~up & said), F.count_if(~up)).alias("false_positive_rate"))
