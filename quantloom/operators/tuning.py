"""Scores of many candidates on many folds.

A linear model with elastic-net penalty and squared loss needs only cross products of its data. One scan of the panel
gives those of every fold's training and validation rows; a task a fold then walks the whole path of penalties on them.
Any other model is scored on the same rows fold by fold, and its losses are chosen from by the same rule.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..sources.durable import discard, written
from . import latent, temporal


def shrunk(x: float, by: float) -> float:
    """Nearer to zero by ``by``, and no further."""
    return float(np.sign(x) * max(abs(x) - by, 0.0))


def elastic_net_path(gram: np.ndarray, cross: np.ndarray, penalties: Sequence[tuple[float, float]], rounds: int = 10_000, tolerance: float = 1e-12) -> np.ndarray:
    """Coefficients (a row a penalty) by coordinate descent on ``gram`` and ``cross`` of standardised columns, both over n.

    A penalty is (strength, share of the absolute part); of equal shares the strongest comes first, and each starts from the one before.
    """
    out = np.zeros((len(penalties), len(cross)))
    order = sorted(range(len(penalties)), key=lambda i: (penalties[i][1], -penalties[i][0]))
    for share, own in groupby(order, key=lambda i: penalties[i][1]):
        beta = np.zeros(len(cross))
        for i in own:
            strength = penalties[i][0]
            for _ in range(rounds):
                moved = 0.0
                for j in range(len(cross)):
                    if gram[j, j] <= 0:
                        continue
                    after = shrunk(cross[j] - gram[j] @ beta + gram[j, j] * beta[j], strength * share) / (gram[j, j] + strength * (1 - share))
                    moved, beta[j] = max(moved, abs(after - beta[j])), after
                if moved < tolerance:
                    break
            out[i] = beta
    return out


def _split(m: np.ndarray, p: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(n, means, second moments, cross moments with the target, its mean, its second moment), the latter five over n."""
    a = m[: (p + 2) ** 2].reshape(p + 2, p + 2)  # features, a constant, the target
    n = a[p, p]
    return n, a[:p, p] / n, a[:p, :p] / n, a[:p, p + 1] / n, a[p + 1, p] / n, a[p + 1, p + 1] / n


def elastic_net_folds(df: DataFrame, time: str, folds: DataFrame, features: Sequence[str], target: str, candidates: Sequence[tuple[float, float]]) -> DataFrame:
    """``fold, candidate, loss, coefficients, intercept, n_train, n_val``: mean squared validation error of each penalty (strength, share) on each fold.

    All of it is made from one scan of ``df``. Features are standardised by their training rows, the intercept isn't penalised. Rows with a
    missing number don't count, for any candidate, so all score the same rows. A fold without validation rows or without two training rows
    is an error, as is a loss that isn't finite.
    """
    if any(not strength >= 0 or not 0 <= share <= 1 for strength, share in candidates):
        raise ValueError("a penalty has a strength of 0 or more and a share from 0 to 1")
    p, many = len(features), folds.select("fold").distinct().count()
    rows = temporal.assign(df.select(time, *[finite(F.col(c).cast("double")).alias(c) for c in [*features, target]]).dropna(), time, folds).where("part <> 'test'")
    keyed = rows.select(F.concat_ws("|", "fold", "part").alias("_key"), *features, F.lit(1.0).alias("_constant"), F.col(target).alias("_target"))
    sums = latent.moments(keyed.withColumn("_again", F.col("_target")), "_key", "_again", [*features, "_constant", "_target"])
    sums = written(sums.select(F.split("_key", r"\|")[0].cast("long").alias("fold"), F.split("_key", r"\|")[1].alias("part"), "n", "m"), "fold-moments")
    sizes = {(r.fold, r.part): r.n for r in sums.select("fold", "part", "n").collect()}  # two rows a fold
    if len(sizes) < 2 * many or any(n < 2 for (_, part), n in sizes.items() if part == "train"):
        raise ValueError(f"not every fold has rows to train and to score on: {dict(sorted(sizes.items()))}")

    def path(fold: pa.Table) -> pa.Table:
        by = {k: np.frombuffer(m, np.float64) for k, m in zip(fold["part"].to_pylist(), fold["m"].to_pylist(), strict=True)}
        n, mean, second, cross, y, _ = _split(by["train"], p)
        sd = np.sqrt(np.maximum(np.diag(second) - mean**2, 0))
        sd[sd <= 1e-12 * np.sqrt(np.maximum(np.diag(second), 1e-300))] = np.inf  # no spread, no weight
        beta = elastic_net_path((second - np.outer(mean, mean)) / np.outer(sd, sd), (cross - mean * y) / sd, candidates) / sd
        base = y - beta @ mean
        k, v_mean, v_second, v_cross, v_y, v_yy = _split(by["val"], p)
        loss = v_yy - 2 * (beta @ v_cross + base * v_y) + np.einsum("ci,ij,cj->c", beta, v_second, beta) + 2 * base * (beta @ v_mean) + base**2
        names = {"fold": pa.array([fold["fold"][0].as_py()] * len(beta), pa.int64()), "candidate": pa.array(range(len(beta)), pa.int64()), "loss": pa.array(loss), "coefficients": pa.array(beta.tolist(), pa.list_(pa.float64()))}
        return pa.table(names | {"intercept": pa.array(base), "n_train": pa.array([int(n)] * len(beta)), "n_val": pa.array([int(k)] * len(beta))})

    schema = "fold bigint, candidate bigint, loss double, coefficients array<double>, intercept double, n_train bigint, n_val bigint"
    found = written(sums.groupBy("fold").applyInArrow(path, schema), "fold-scores")
    discard(sums)
    check_losses(found)
    return found


def score_folds(df: DataFrame, time: str, folds: DataFrame, keys: Sequence[str], candidates: Sequence[Mapping], fit: Callable[[Mapping, DataFrame], Callable[[DataFrame], DataFrame]], loss: Column, lookback: int = 0) -> DataFrame:
    """``fold, candidate, loss, n_val, keys_hash`` of any model: ``fit(candidate, training rows)`` gives a function that scores validation rows.

    Scored are the rows from the fold's ``val_start`` to its ``val_end``; models see ``lookback`` dates more before them. ``loss`` is an aggregate over
    what the model returns. A candidate has to score the same rows (``keys``) as the first one; that, and a loss that isn't finite, is an error.
    """
    out = None
    for f in folds.orderBy("fold").collect():  # a row a fold
        train = df.where(F.col(time).between(F.lit(f.train_start), F.lit(f.train_end)))
        seen = temporal.window_with_history(df, time, f.val_start, f.val_end, lookback)
        for i, c in enumerate(candidates):
            scored = fit(c, train)(seen).where(F.col(time).between(F.lit(f.val_start), F.lit(f.val_end)))
            one = scored.agg(loss.cast("double").alias("loss"), F.count("*").alias("n_val"), F.sum(F.xxhash64(*keys).cast("decimal(38,0)")).cast("string").alias("keys_hash"))
            one = one.select(F.lit(f.fold).cast("long").alias("fold"), F.lit(i).cast("long").alias("candidate"), "loss", "n_val", "keys_hash")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no fold")
    found = written(out, "fold-scores")
    check_losses(found)
    first = found.where("candidate = 0").select("fold", F.col("n_val").alias("_n"), F.col("keys_hash").alias("_h"))
    if odd := found.join(first, "fold").where(~F.col("n_val").eqNullSafe(F.col("_n")) | ~F.col("keys_hash").eqNullSafe(F.col("_h"))).limit(5).collect():
        raise ValueError(f"candidates that score other rows than the first: {[(r.fold, r.candidate) for r in odd]}")
    return found


def check_losses(scores: DataFrame) -> None:
    """Every loss is a finite number."""
    if odd := scores.where(finite(F.col("loss")).isNull()).limit(5).collect():
        raise ValueError(f"loss is not finite for (fold, candidate) {[(r.fold, r.candidate) for r in odd]}")


def choose(scores: DataFrame, baseline: int = 0, margin: float = 1.0, min_folds: int = 1) -> DataFrame:
    """One row: ``best`` and ``adopted``, mean losses, gain and its paired standard error.

    The best candidate has the smallest mean loss, of equal ones the baseline and then the first; it is adopted only if it gains more
    than ``margin`` standard errors over the baseline. Fewer folds than ``min_folds`` is an error.
    """
    if (many := scores.select("fold").distinct().count()) < min_folds:
        raise ValueError(f"{many} folds, but {min_folds} are needed")
    means = scores.groupBy("candidate").agg(F.avg("loss").alias("mean"))
    best = means.agg(F.min(F.struct("mean", (F.col("candidate") != baseline).alias("other"), "candidate")).alias("b")).select(F.col("b.candidate").alias("best"), F.col("b.mean").alias("best_loss"))
    base = scores.where(F.col("candidate") == baseline).select("fold", F.col("loss").alias("_base"))
    gains = scores.join(base, "fold").join(best, F.col("candidate") == F.col("best")).select("best", "best_loss", "_base", (F.col("_base") - F.col("loss")).alias("_gain"))
    found = gains.groupBy("best", "best_loss").agg(F.avg("_base").alias("baseline_loss"), F.avg("_gain").alias("gain"), F.coalesce(F.stddev_samp("_gain") / F.sqrt(F.count("*")), F.lit(0.0)).alias("standard_error"))
    adopted = (F.col("best") != baseline) & (F.col("gain") > margin * F.col("standard_error"))
    return found.withColumns({"adopted": adopted, "candidate": F.when(adopted, F.col("best")).otherwise(F.lit(baseline).cast("long"))})
