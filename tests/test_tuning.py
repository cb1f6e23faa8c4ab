"""Elastic-net paths and fold scores against direct minimisation on the rows themselves."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import models, temporal, tuning

DAY = dt.date(2019, 1, 1)
PENALTIES = [(10 ** (k / 2 - 4), share) for k in range(13) for share in (0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0)]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(260, 3)) * [1, 10, 0.1] + [0, 5, 100]
    y = 2 + x @ [0.5, 0.0, -3.0] + rng.normal(size=260)
    rows = [(DAY + dt.timedelta(i // 2), i, *map(float, x[i]), float(y[i])) for i in range(260)]
    return x, y, spark.createDataFrame([*rows, (DAY, 900, None, 1.0, 1.0, 1.0), (DAY, 901, math.nan, 1.0, 1.0, 1.0)], "d date, i long, a double, b double, c double, y double")


@pytest.fixture(scope="module")
def folds(panel):
    return temporal.folds(panel[2], "d", temporal.Splitter(train=50, val=10, test=6, purge=1, step=8))


def test_one_scan_scores_all_candidates_on_all_folds(panel, folds):
    x, y, df = panel
    scores = tuning.elastic_net_folds(df.repartition(6), "d", folds, ["a", "b", "c"], "y", PENALTIES).collect()
    bounds = {f.fold: f for f in folds.collect()}
    assert len(bounds) == 8 and len(scores) == 8 * 91
    dates = np.array([DAY + dt.timedelta(i // 2) for i in range(260)])
    for s in scores[::13]:
        f = bounds[s.fold]
        train, val = (dates >= f.train_start) & (dates <= f.train_end), (dates >= f.val_start) & (dates <= f.val_end)
        assert (s.n_train, s.n_val) == (train.sum(), val.sum())
        beta = np.array(s.coefficients)
        assert math.isclose(s.loss, ((y[val] - s.intercept - x[val] @ beta) ** 2).mean(), rel_tol=1e-6)
        # at the minimum no coordinate can gain: the conditions of the penalised problem on standardised columns
        mean, sd = x[train].mean(axis=0), x[train].std(axis=0)
        z, (strength, share) = (x[train] - mean) / sd, PENALTIES[s.candidate]
        pull = z.T @ (y[train] - y[train].mean() - z @ (beta * sd)) / train.sum() - strength * (1 - share) * beta * sd
        for g, b in zip(pull, beta):
            assert abs(g - strength * share * np.sign(b)) < 1e-6 if b else abs(g) <= strength * share + 1e-6
        assert math.isclose(s.intercept, y[train].mean() - beta @ mean, rel_tol=1e-6)


def test_constant_and_equal_columns(panel, folds):
    df = panel[2].withColumns({"flat": F.lit(7.0), "twin": F.col("a")})
    got = tuning.elastic_net_folds(df, "d", folds, ["a", "flat", "twin"], "y", [(0.1, 0.5), (0.0, 0.0)]).where("candidate = 0").first()
    assert got.coefficients[1] == 0 and math.isfinite(got.loss)


def test_what_is_refused(panel, folds):
    x, y, df = panel
    for bad in ([(-1.0, 0.5)], [(1.0, 1.5)], [(math.nan, 0.5)]):
        with pytest.raises(ValueError, match="strength"):
            tuning.elastic_net_folds(df, "d", folds, ["a"], "y", bad)
    with pytest.raises(ValueError, match="rows to train"):
        tuning.elastic_net_folds(df.where("d < '2019-02-01'"), "d", folds, ["a"], "y", [(1.0, 0.5)])
    with pytest.raises(ValueError, match="not finite"):
        tuning.elastic_net_folds(df.withColumn("y", F.when(F.col("i") == 100, 1e308).otherwise(F.col("y"))), "d", folds, ["a"], "y", [(1.0, 0.5)])


def test_any_model_on_folds(panel, folds):
    df = panel[2].dropna()
    few = folds.where("fold < 2")

    def fit(c, train):
        mean = train.agg(F.avg("y")).first()[0] * c["k"]
        return lambda rows: rows.withColumn("score", F.lit(mean)).where(F.col("i") % 7 != c.get("skip", 9))

    loss = F.avg((F.col("score") - F.col("y")) ** 2)
    got = tuning.score_folds(df, "d", few, ["d", "i"], [{"k": 0.0}, {"k": 1.0}], fit, loss, lookback=3).collect()
    assert len(got) == 4 and {r.n_val for r in got} == {20}
    with pytest.raises(ValueError, match="other rows"):
        tuning.score_folds(df, "d", few, ["d", "i"], [{"k": 0.0}, {"k": 1.0, "skip": 3}], fit, loss)
    with pytest.raises(ValueError, match="not finite"):
        tuning.score_folds(df, "d", few, ["d", "i"], [{"k": math.nan}], fit, loss)
    with pytest.raises(ValueError, match="no fold"):
        tuning.score_folds(df, "d", few.limit(0), ["d", "i"], [{"k": 1.0}], fit, loss)


def test_choice(spark):
    rows = [(f, c, x) for c, xs in enumerate([[1.0, 1.0, 1.0], [0.9, 0.8, 0.9], [0.2, 1.6, 0.8], [0.2, 1.6, 0.8]]) for f, x in enumerate(xs)]
    scores = spark.createDataFrame(rows, "fold long, candidate long, loss double")
    pick = lambda *cs: tuning.choose(scores.where(F.col("candidate").isin(0, *cs))).first()
    assert pick(1).adopted and pick(1).candidate == 1
    noisy = pick(3, 2)
    assert noisy.best == 2 and not noisy.adopted and noisy.candidate == 0 and math.isclose(noisy.gain, 0.4 / 3)
    table = {0: [1.0, 1.0, 1.0], 1: [0.9, 0.8, 0.9]}
    want = models.select({"k": 0}, [{"k": 1}], lambda c: table[c["k"]])[1]
    assert math.isclose(pick(1).standard_error, want["standard_error"]) and math.isclose(pick(1).best_loss, want["best_loss"])
    assert not tuning.choose(scores.where("candidate = 0")).first().adopted
    with pytest.raises(ValueError):
        tuning.choose(scores, min_folds=4)
