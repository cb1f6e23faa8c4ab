"""Tests and regressions on many date series against NumPy on each series alone."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import inference
from quantloom.operators import series_tests as st

DAY = dt.date(2020, 1, 1)
NAN = float("nan")


@pytest.fixture(scope="module")
def data():
    """Series of 5 to 900 dates with holes, among them a constant and a collinear one."""
    rng, out = np.random.default_rng(7), {}
    for name, n in (("a", 900), ("b", 300), ("c", 40), ("d", 5), ("flat", 60), ("twin", 80), (None, 50)):
        f, g = rng.normal(size=n), rng.normal(size=n)
        e = np.convolve(rng.normal(size=n + 3), [1, 0.6, 0.3, 0.1], "valid")
        y = 0.1 + 0.5 * f - 0.2 * g + 0.5 * e
        if name == "flat":
            y = np.zeros(n)
        if name == "twin":
            g = f.copy()
        if n > 100:
            y[3], f[10], g[20] = NAN, math.inf, NAN
        out[name] = (y, f, g)
    return out


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(m, DAY + dt.timedelta(i), *map(float, v)) for m, xs in data.items() for i, v in enumerate(zip(*xs))]
    return spark.createDataFrame(rows, "m string, d date, y double, f double, g double").repartition(7).withColumns({"n": F.lit(3), "_e": F.lit("clash"), "t": F.lit("clash")})


def close(a, b):
    a, b = (NAN if x is None else x for x in (a, b))
    return math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-9) or math.isnan(a) and math.isnan(b)


def complete(data, m):
    y, f, g = data[m]
    ok = np.isfinite(y) & np.isfinite(f) & np.isfinite(g)
    return y[ok], np.column_stack([f, g])[ok]


@pytest.mark.parametrize("lag, alternative", [(None, "two-sided"), (0, "greater"), (3, "less"), (200, "greater")])
def test_hac_mean(frame, data, lag, alternative):
    got = {r.m: r for r in st.hac_mean(frame, ["m"], "d", "y", 0.05, lag, alternative).collect()}
    assert set(got) == set(data)
    for m, (y, _, _) in data.items():
        want = inference.hac_mean_test(y, 0.05, lag, alternative)
        assert got[m].n == want.observations and close(got[m].mean, want.estimate) and close(got[m].standard_error, want.standard_error) and close(got[m].t, want.statistic) and close(got[m].p_value, want.p_value), m
    whole = st.hac_mean(frame.where("m = 'a'"), [], "d", "y").first()
    assert close(whole.mean, inference.hac_mean_test(data["a"][0]).estimate)
    assert st.hac_mean(frame.limit(0), ["m"], "d", "y").count() == 0
    with pytest.raises(ValueError):
        st.sided(F.lit(1.0), F.lit(1.0), "both")


def test_one_and_two_rows(spark):
    rows = spark.createDataFrame([("one", DAY, 1.0), ("two", DAY, 1.0), ("two", DAY + dt.timedelta(1), 2.0), ("none", DAY, None)], "m string, d date, y double")
    got = {r.m: r for r in st.hac_mean(rows, ["m"], "d", "y").collect()}
    assert set(got) == {"one", "two"} and got["one"].mean is None and got["one"].p_value is None
    assert close(got["two"].mean, 1.5) and close(got["two"].standard_error, 0.25) and close(got["two"].t, 6.0)  # one lag of half weight


@pytest.mark.parametrize("lag", [None, 0, 4])
def test_factor_alpha(frame, data, lag):
    got = {r.m: r for r in st.factor_alpha(frame, ["m"], "d", "y", ["f", "g"], lag=lag).collect()}
    for m in data:
        want = inference.factor_alpha(*complete(data, m), lag=lag)
        for ours, theirs in (("alpha", "alpha"), ("annualized_alpha", "annualized_alpha"), ("standard_error", "standard_error"), ("t", "t"), ("p_value", "p_value"), ("r_squared", "r_squared"), ("n", "observations")):
            assert close(got[m][ours], want[theirs]), (m, ours)
        assert close(got[m].betas["f"], want["betas"][0]) and close(got[m].betas["g"], want["betas"][1])
        assert got[m].beta_p_values.keys() == {"f", "g"}
    short = frame.where("m = 'd' and d < date'2020-01-04'")
    assert st.factor_alpha(short, ["m"], "d", "y", ["f", "g"]).count() == 0  # as many rows as coefficients


def test_timing_model(spark, data):
    """Instruments are demeaned on complete rows only, lagged in their own calendar; a missing market is an error."""
    rng = np.random.default_rng(1)
    y, f, g = data["a"]
    z = rng.normal(2, 1, len(y))
    z[50:60] = NAN
    dates = [DAY + dt.timedelta(i) for i in range(len(y))]
    rows = spark.createDataFrame([(m, d, *map(float, v)) for m in ("a", "b") for d, v in zip(dates, zip(y, f, g))], "m string, d date, y double, f double, g double")
    instruments = spark.createDataFrame([(d, float(x)) for d, x in zip(dates, z)], "d date, z double")
    z = np.append(NAN, z[:-1])
    ok = np.isfinite(y) & np.isfinite(f) & np.isfinite(g) & np.isfinite(z)
    c = z[ok] - z[ok].mean()
    x = np.column_stack([c, f[ok], f[ok] * c, g[ok], f[ok] ** 2])
    want = inference.factor_alpha(y[ok], x)
    got = st.timing_model(rows, ["m"], "d", "y", "f", ["g"], instruments).collect()
    assert len(got) == 2
    for r in got:
        assert close(r.alpha, want["alpha"]) and close(r.alpha_p_value, want["p_value"]) and close(r.r_squared, want["r_squared"]) and r.n == want["observations"]
        assert [close(r.coefficients[n], b) for n, b in zip(["alpha_z", "f", "f_x_z", "g", "f_squared"], want["betas"])] == [True] * 5
        assert close(r.market_beta, want["betas"][1]) and close(r.timing_gamma, want["betas"][4])
    plain = st.timing_model(rows, ["m"], "d", "y", "f", [], instruments, square=False, conditional_alpha=False).first()
    assert plain.timing_gamma is None and set(plain.coefficients) == {"f", "f_x_z"}
    with pytest.raises(ValueError):
        st.timing_model(rows, ["m"], "d", "y", "absent", [], instruments)
    with pytest.raises(ValueError):
        st.timing_model(rows, ["m"], "d", "y", "f", [], instruments.withColumnRenamed("z", "f"))


def test_differences_spanning_and_paths(frame, data):
    y, x = complete(data, "b")
    got = {r.m: r for r in st.spanning_test(frame, ["m"], "d", "y", ["f", "g"]).collect()}
    want = inference.spanning_test(y, x)
    assert close(got["b"].statistic, want.statistic) and close(got["b"].p_value, want.p_value)
    pairs = {(r.a, r.b): r for r in st.alpha_difference(frame, "m", "d", "y", ["f", "g"]).collect()}
    ya, yc = data["a"][0][:40], data["c"][0]
    ok = np.isfinite(ya) & np.isfinite(data["a"][1][:40]) & np.isfinite(data["a"][2][:40])
    want = inference.alpha_difference(ya[ok], yc[ok], np.column_stack(data["a"][1:])[:40][ok])
    assert close(pairs["a", "c"].alpha_difference, want["alpha"]) and close(pairs["a", "c"].p_value, want["p_value"])
    rolled = {r.d: r for r in st.rolling_betas(frame.where("m = 'c'"), ["m"], "d", "y", ["f", "g"], 20).collect()}
    y, x = complete(data, "c")
    plain = inference.rolling_betas(y, x, 20)
    assert len(rolled) == 21
    assert close(rolled[DAY + dt.timedelta(30)].betas["g"], plain[30, 2]) and close(rolled[DAY + dt.timedelta(39)].alpha, plain[39, 0])
    with pytest.raises(ValueError):
        st.rolling_betas(frame, ["m"], "d", "y", ["f", "g"], 3)
    path = [r.cumulative_alpha for r in st.cumulative_alpha(frame.where("m = 'c'"), ["m"], "d", "y", ["f", "g"]).orderBy("d").collect()]
    assert np.allclose(path, inference.cumulative_alpha(y, x))


def test_joint_alpha(spark):
    rng = np.random.default_rng(4)
    n = 400
    f = rng.normal(size=(n, 2))
    y = np.column_stack([f @ [0.5, 0.2] + rng.normal(0, 1, n) + s for s in (0.0, 0.1, 0.3)])
    y = np.column_stack([y, y[:, 0]])  # a portfolio that is there twice adds nothing
    rows = [(fam, f"p{j}", DAY + dt.timedelta(i), float(y[i, j]), *map(float, f[i])) for fam, js in (("three", (0, 1, 2)), ("four", (0, 1, 2, 3)), ("one", (1,))) for i in range(n) for j in js]
    rows += [("short", f"p{j}", DAY + dt.timedelta(i), float(y[i, j]), *map(float, f[i])) for i in range(5) for j in (0, 1, 2)]
    rows += [("three", "p0", DAY + dt.timedelta(n), 9.0, 1.0, 1.0)]  # a date that not all have
    df = spark.createDataFrame(rows, "fam string, p string, d date, y double, f double, g double")
    got = {r.fam: r for r in st.joint_alpha_test(df, ["fam"], "p", "d", "y", ["f", "g"]).collect()}
    want = inference.joint_alpha_test(y[:, :3], f)
    for fam in ("three", "four"):
        assert math.isclose(got[fam].statistic, want.statistic, rel_tol=1e-6) and math.isclose(got[fam].p_value, want.p_value, rel_tol=1e-6) and got[fam].n == n
    assert math.isclose(got["one"].statistic, inference.joint_alpha_test(y[:, 1:2], f).statistic, rel_tol=1e-6)
    assert got["short"].statistic is None and got["short"].p_value is None


def test_predictive_tests(frame, data):
    ic = {r.m: r for r in st.information_coefficient(frame, ["m"], "d", "y", 252).collect()}
    y = data["a"][0][np.isfinite(data["a"][0])]
    want = inference.hac_mean_test(y, alternative="greater")
    assert close(ic["a"].mean_ic, want.estimate) and close(ic["a"].ic_p_value, want.p_value) and close(ic["a"].information_ratio, y.mean() / y.std(ddof=1))
    assert close(ic["a"].ic_ci_high, want.estimate + 1.959963984540054 * want.standard_error) and ic["flat"].information_ratio is None
    hit = {r.m: r for r in st.directional_accuracy(frame, ["m"], "d", "y", 0.05).collect()}
    assert close(hit["a"].hit_rate_p_value, inference.hac_mean_test(y, 0.05, alternative="greater").p_value)
    pt = {r.m: r for r in st.pesaran_timmermann(frame.withColumns({"up": F.col("f") > 0, "rose": F.col("y") > 0}), ["m"], "up", "rose").collect()}
    y, f = data["c"][0] > 0, data["c"][1] > 0
    want = inference.pesaran_timmermann(f, y)
    assert close(pt["c"].statistic, want.statistic) and close(pt["c"].p_value, want.p_value) and close(pt["c"].hit_rate, want.estimate)
    assert pt["flat"].statistic is None and pt["flat"].p_value is None
    dm = {(r.a, r.b): r for r in st.diebold_mariano(frame, "m", "d", "y", horizon=2).collect()}
    want = inference.diebold_mariano(data["b"][0][:40], data["c"][0], horizon=2)
    assert close(dm["b", "c"].statistic, want.statistic) and close(dm["b", "c"].p_value, want.p_value)


def test_profit_needs_a_cross_section(spark):
    rows = spark.createDataFrame([("m", DAY, 1.0, 0.2), ("m", DAY, -1.0, 0.1), ("m", DAY, 0.0, -0.3), ("m", DAY + dt.timedelta(1), 1.0, 0.5), ("m", DAY, None, 0.5)], "m string, d date, s double, r double")
    got = {r.d: r for r in st.daily_excess_profit(rows, ["m"], "d", "s", "r").collect()}
    assert close(got[DAY].excess_profit, np.cov([1, -1, 0], [0.2, 0.1, -0.3], bias=True)[0, 1]) and got[DAY].n == 3 and close(got[DAY].hit_rate, 1 / 3)
    assert got[DAY + dt.timedelta(1)].excess_profit is None


def test_ten_thousand_models_in_one_pass(spark):
    """As many models as one likes: the plan has no collect, and the work is one window a series."""
    models = spark.range(10_000).select(F.col("id").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
    rows = models.select("m", F.date_add(F.lit(DAY), F.col("i")).alias("d"), (F.sin(F.col("m") + F.col("i") * 1.7) + F.col("i") % 3).alias("y"), F.cos(F.col("i") * 1.0).alias("f"))
    got = st.factor_alpha(rows, ["m"], "d", "y", ["f"]).agg(F.count("*").alias("n"), F.count("alpha").alias("k"), F.avg("n").alias("rows")).first()
    assert (got.n, got.k, got.rows) == (10_000, 10_000, 12.0)
