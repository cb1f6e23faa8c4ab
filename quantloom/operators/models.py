"""Baselines, classifiers on Spark's own library, and the choice of hyperparameters."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equal_weight(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Score 1 on rows with any feature."""
    return df.where(F.coalesce(*[F.col(c).cast("string") for c in features]).isNotNull()).withColumn("score", F.lit(1.0))


def inverse_volatility(df: DataFrame, volatility: str, floor: float = 1e-8) -> DataFrame:
    return df.where(F.col(volatility) > 0).withColumn("score", 1 / F.greatest(F.col(volatility), F.lit(floor)))


@dataclass
class Fitted:
    """A fitted pipeline, or a constant where training saw one class."""

    pipeline: object | None
    features: Sequence[str]

    def score(self, df: DataFrame) -> DataFrame:
        """``probability`` of class 1 and ``score`` in [-1, 1]."""
        if self.pipeline is None:
            return df.withColumn("probability", F.lit(0.5)).withColumn("score", F.lit(0.0))
        from pyspark.ml.functions import vector_to_array

        out = self.pipeline.transform(df.withColumns({c: F.col(c).cast("double") for c in self.features}))
        out = out.withColumn("_p", F.get(vector_to_array("probability"), 1))
        return out.select(*df.columns, F.col("_p").alias("probability"), (2 * F.col("_p") - 1).alias("score"))


def fit_classifier(df: DataFrame, features: Sequence[str], label: str, kind: str = "logistic", standardise: bool = True, **options) -> Fitted:
    """``logistic`` (elastic net: ``c``, ``l1_ratio``) or ``forest``; missing features take their training mean, else 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    rows = df.where(F.col(label).isNotNull()).withColumns({c: F.col(c).cast("double") for c in features}).withColumn(label, F.col(label).cast("double"))
    classes = {r[0]: r[1] for r in rows.groupBy(label).count().limit(3).collect()}
    if set(classes) - {0.0, 1.0}:
        raise ValueError("labels must be 0 or 1")
    if len(classes) < 2:
        return Fitted(None, features)
    empty = rows.agg(*[F.count(c).alias(c) for c in features]).first()
    known = [c for c in features if empty[c]]
    filled = [f"_{c}" for c in known]
    stages = [Imputer(inputCols=known, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__assembled", handleInvalid="keep")]
    if standardise:
        stages.append(StandardScaler(inputCol="__assembled", outputCol="__scaled", withMean=True))
    column = "__scaled" if standardise else "__assembled"
    if kind == "logistic":
        n = sum(classes.values())
        stages.append(LogisticRegression(featuresCol=column, labelCol=label, elasticNetParam=options.get("l1_ratio", 0.0), regParam=1 / (options.get("c", 1.0) * n), maxIter=options.get("max_iter", 100), standardization=False))
    elif kind == "forest":
        stages.append(RandomForestClassifier(featuresCol=column, labelCol=label, numTrees=options.get("trees", 50), maxDepth=options.get("depth", 5), minInstancesPerNode=options.get("leaf", 1), seed=options.get("seed", 42)))
    else:
        raise ValueError(f"unknown classifier {kind}")
    return Fitted(Pipeline(stages=stages).fit(rows), features)


def losses(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """Squared and absolute error over rows with both, and cross-entropy of the prediction as a logit."""
    e, x, y = F.col(prediction) - F.col(target), F.col(prediction), F.col(target)
    ce = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return df.where(x.isNotNull() & y.isNotNull()).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(ce).alias("bce"), F.avg(((x > 0) == (y > 0.5)).cast("double")).alias("accuracy"))


def choices(*values) -> Callable:
    return lambda rng: rng.choice(values)


def log_range(low: float, high: float) -> Callable:
    return lambda rng: math.exp(rng.uniform(math.log(low), math.log(high)))


def int_range(low: int, high: int) -> Callable:
    return lambda rng: rng.randint(low, high)


def grid(space: Mapping[str, Sequence], baseline: Mapping) -> list[dict]:
    return [dict(baseline) | dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]


def random_search(space: Mapping[str, Callable], baseline: Mapping, n: int, seed: int) -> list[dict]:
    """``n`` distinct draws, the same for a seed; stops when no new ones come."""
    rng, out = random.Random(seed), []
    for _ in range(50 * n):
        c = dict(baseline) | {k: draw(rng) for k, draw in space.items()}
        if c not in out:
            out.append(c)
        if len(out) == n:
            break
    return out


def select(baseline: Mapping, candidates: Sequence[Mapping], fold_losses: Callable[[Mapping], Sequence[float]]) -> tuple[Mapping, dict]:
    """The candidate with the strictly smallest mean loss, adopted only if it beats the baseline by one paired standard error.

    ``fold_losses`` scores a candidate on the same folds every time; a loss that isn't finite is an error.
    """

    def scored(c: Mapping) -> np.ndarray:
        x = np.asarray(fold_losses(c), np.float64)
        if not np.isfinite(x).all():
            raise ValueError(f"loss of {dict(c)} is not finite")
        return x

    base = scored(baseline)
    best, best_losses = baseline, base
    for c in candidates:
        x = scored(c)
        if x.mean() < best_losses.mean():
            best, best_losses = c, x
    gain = base - best_losses
    error = gain.std(ddof=1) / math.sqrt(len(gain)) if len(gain) > 1 else 0.0
    adopted = best is not baseline and gain.mean() > error
    return (best if adopted else baseline), {"baseline_loss": float(base.mean()), "best_loss": float(best_losses.mean()), "gain": float(gain.mean()), "standard_error": float(error), "adopted": bool(adopted)}
