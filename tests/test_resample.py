"""Bootstraps against loops over the same drawn positions, under any partitioning."""

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import inference, resample

DAY = dt.date(2021, 1, 1)


def positions(n, r, block, seed):
    """What a resample draws, position by position."""
    out, k = [], 0
    while len(out) < n:
        h = hashlib.md5(f"{seed}:{r}:{k}".encode()).hexdigest()
        u, v = ((int(h[i : i + 12], 16) + 0.5) / (1 << 48) for i in (0, 12))
        length = 1 if block <= 1 else math.floor(math.log(u) / math.log1p(-1 / block)) + 1
        start = math.floor(v * n)
        out += [(start + i) % n for i in range(min(length, n - len(out)))]
        k += 1
    return np.array(out)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    out = {m: rng.normal(mu, 1, n) for m, mu, n in (("a", 0.1, 300), ("b", 0.05, 300), ("c", -0.4, 300), ("short", 0.3, 7), ("one", 0, 1))}
    return out | {"flat": np.full(300, 0.25), "twin": out["a"].copy()}


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(m, DAY + dt.timedelta(i), float(v)) for m, xs in data.items() for i, v in enumerate(xs)]
    rows += [("a", DAY + dt.timedelta(900), math.nan), ("b", DAY + dt.timedelta(901), None)]
    return spark.createDataFrame(rows, "m string, d date, x double").withColumn("n", F.lit("clash"))


def sharpe(x):
    s = x.std(ddof=1)
    return x.mean() / s if s > 1e-12 else None


@pytest.mark.parametrize("block", [1, 10, 400])
def test_sums_of_what_is_drawn(frame, data, block):
    got = resample.resampled(frame, ["m"], "d", {"v": F.col("x")}, 300, block, 9).collect()
    assert len(got) == 300 * len(data)
    for r in got[::7]:
        x = data[r.m]
        assert r.n == len(x) and math.isclose(r.sums[0], x[positions(len(x), r.r, block, 9)].sum(), rel_tol=1e-9, abs_tol=1e-9)


def test_positions_are_drawn_evenly_in_blocks_of_the_mean_length():
    n, all_ = 50, [positions(50, r, 5, 1) for r in range(2000)]
    assert np.allclose(np.bincount(np.concatenate(all_), minlength=n) / 2000, 1, atol=0.15)
    goes_on = np.mean([(np.diff(p) % n == 1).mean() for p in all_])
    assert abs(goes_on - (0.8 + 0.2 / n)) < 0.01


def test_sharpe_significance(frame, data):
    kw = dict(times=400, block=8, seed=3)
    got = {r.m: r for r in resample.sharpe_significance(frame, ["m"], "d", "x", **kw).collect()}
    again = {r.m: r for r in resample.sharpe_significance(frame.repartition(11), ["m"], "d", "x", **kw).collect()}
    assert set(got) == set(data)
    for m, x in data.items():
        ratios = [s for r in range(400) if len(x) > 1 and (s := sharpe(x[positions(len(x), r, 8, 3)])) is not None]
        if m in ("one", "flat"):
            assert got[m].annualized_sharpe is None and got[m].sharpe_ci_low is None
            continue
        low, high = np.quantile(np.array(ratios) * 252**0.5, [0.025, 0.975])
        assert math.isclose(got[m].annualized_sharpe, sharpe(x) * 252**0.5) and math.isclose(got[m].sharpe_ci_low, low, rel_tol=1e-6) and math.isclose(got[m].sharpe_ci_high, high, rel_tol=1e-6)
        assert math.isclose(got[m].sharpe_p_value, inference.hac_mean_test(x, alternative="greater").p_value, rel_tol=1e-6)
        assert math.isclose(again[m].sharpe_ci_low, got[m].sharpe_ci_low, rel_tol=1e-9)
    whole = resample.sharpe_significance(frame.where("m = 'a'"), [], "d", "x", **kw).first()
    assert math.isclose(whole.sharpe_ci_low, got["a"].sharpe_ci_low)


def test_sharpe_differences(frame, data):
    got = {(r.a, r.b): r for r in resample.sharpe_differences(frame, "m", "d", "x", times=300, block=8, seed=3).collect()}
    assert len(got) == 21
    for a, b in (("a", "b"), ("a", "c"), ("b", "short")):
        n = min(len(data[a]), len(data[b]))
        x, y = data[a][:n], data[b][:n]
        d, drawn = sharpe(x) - sharpe(y), [positions(n, r, 8, 3) for r in range(300)]
        p = (1 + sum(abs(sharpe(x[i]) - sharpe(y[i]) - d) >= abs(d) for i in drawn)) / 301
        want, _ = inference.sharpe_difference(x, y, times=2)
        assert math.isclose(got[a, b].bootstrap_p_value, p) and math.isclose(got[a, b].z_statistic, want.statistic, rel_tol=1e-6) and math.isclose(got[a, b].z_p_value, want.p_value, rel_tol=1e-6)
    assert got["a", "flat"].bootstrap_p_value is None and got["a", "one"].n == 1 and got["a", "twin"].sharpe_difference == 0


def test_confidence_set(spark, frame, data):
    families = frame.where("m <> 'one' and m <> 'short'").withColumn("fam", F.lit("x")).unionByName(frame.where("m in ('a', 'one')").withColumn("fam", F.lit("y"))).unionByName(frame.where("m = 'b'").withColumn("fam", F.lit("z")))
    got = {(r.fam, r.m): r for r in resample.confidence_set(families.withColumn("loss", -F.col("x")), ["fam"], "m", "d", "loss", times=300, block=8, seed=3).collect()}
    names = ["a", "b", "c", "flat"]
    boot = np.stack([[-data[m][i].mean() for m in names] for i in (positions(300, r, 8, 3) for r in range(300))])
    want = dict(zip(names, inference.eliminated(np.array([-data[m].mean() for m in names]), boot)))
    for m in names:
        assert math.isclose(got["x", m].mcs_p_value, want[m], abs_tol=1e-9) and got["x", m].in_confidence_set == (want[m] >= 0.1)
    assert got["x", "twin"].mcs_p_value == got["x", "a"].mcs_p_value  # equal losses share a verdict
    assert not got["x", "c"].in_confidence_set and got["x", "flat"].in_confidence_set
    assert got["y", "a"].mcs_p_value is None and got["y", "a"].in_confidence_set and got["z", "b"].in_confidence_set
    assert resample.confidence_set(frame.limit(0), [], "m", "d", "x").count() == 0


def test_significance_frame_and_matrix(spark, frame, data):
    daily = frame.where("m in ('a', 'b')").withColumnRenamed("x", "excess_return")
    per_date = frame.where("m in ('b', 'c')").select("m", "d", F.col("x").alias("rank_ic"), (F.col("x") / 10 + 0.5).alias("hit_rate"))
    rows = {r.m: r for r in resample.significance_frame(daily, per_date, "m", "d", times=100).collect()}
    assert set(rows) == {"a", "b", "c"} and "excess_profitability" not in rows["a"].asDict()
    assert rows["a"].mean_ic is None and rows["c"].annualized_sharpe is None
    assert math.isclose(rows["b"].ic_p_value, inference.hac_mean_test(data["b"], alternative="greater").p_value, rel_tol=1e-6)
    cells = {(r.row, r.column): r.value for r in resample.symmetric(spark.createDataFrame([("a", "b", 0.1), ("a", "c", 0.2), ("b", "c", None)], "a string, b string, p double"), "p", 1.0).collect()}
    assert len(cells) == 9 and cells["b", "a"] == cells["a", "b"] == 0.1 and cells["c", "c"] == 1.0 and cells["c", "b"] is None


def test_too_long_series(spark, monkeypatch):
    monkeypatch.setattr(resample, "MOST_DATES", 10)
    rows = spark.range(11).select(F.lit("a").alias("m"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("d"), F.rand(1).alias("x"))
    with pytest.raises(Exception, match="not a date series"):
        resample.resampled(rows, ["m"], "d", {"v": F.col("x")}, 5, 2, 1).collect()
