"""Operators on small frames with values worked out by hand or by plain loops."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import kurtosis_unbiased, number, pearson, skewness_unbiased
from quantloom.operators import align, clean, features, inference, latent, models, portfolio, signals, temporal
from quantloom.panel import Panel
from quantloom.sources import ColumnSpec, View, fingerprint, load

D = [dt.date(2020, 1, i) for i in range(1, 31)]


def test_asof_segments_observed_age(spark):
    """A source from before the segment is fenced off; a row outside its spells is no grid row."""
    spans = [(D[1], D[3])] * 3 + [(None, None)] + [(D[5], D[6])] * 2
    primary = Panel(spark.createDataFrame([(D[i + 1], 1, a, b) for i, (a, b) in enumerate(spans)], "d date, e long, s date, t date"))
    source = Panel(spark.createDataFrame([(D[0], 1, 9.0), (D[2], 1, 5.0), (D[4], 1, 7.0), (D[6], 1, 7.0)], "d date, e long, f double"))
    got = align.align_and_mask(primary, [source], [("s", "t")]).df.orderBy("d").collect()
    assert [(r.d, r.f, r.f__observed, r.f__age) for r in got] == [(D[1], None, False, -1), (D[2], 5.0, True, 0), (D[3], 5.0, False, 1), (D[5], None, False, -1), (D[6], 7.0, True, 0)]
    assert len({r.segment for r in got}) == 2


def test_impute_without_group_key(spark):
    df = spark.createDataFrame([(D[0], 1, 1.0), (D[1], 1, None), (D[0], None, 2.0), (D[1], None, None)], "d date, e long, x double")
    p = Panel(df.withColumn("k", F.lit(0)), extra_keys=("k",))
    assert sorted((r.d, r.e, r.x) for r in clean.impute(p, ["x"]).df.collect()) == [(D[0], 1, 1.0), (D[1], 1, 1.0)]


def test_deduplicate_averages_dates(spark):
    df = spark.createDataFrame([(D[0], 1, 1.0, D[0]), (D[0], 1, None, D[2]), (None, 1, 5.0, D[0])], "d date, e long, a double, m date")
    assert [tuple(r) for r in clean.deduplicate(Panel(df)).df.collect()] == [(D[0], 1, 1.0, D[1])]


def test_consistency_policies(spark):
    p = Panel(spark.createDataFrame([(D[0], 1, 3.0, 2.0), (D[0], 2, None, 2.0), (D[0], 3, 1.0, 2.0)], "d date, e long, low double, high double"))
    rule = (clean.Constraint(("low",), "le", "high"),)
    out = lambda how: sorted((r.e, r.low, r.high) for r in clean.consistency_check(p, [clean.Rule("x", rule, how)]).df.collect())
    assert out("left") == [(1, None, 2.0), (2, None, 2.0), (3, 1.0, 2.0)]
    assert out("operands") == [(1, None, None), (2, None, 2.0), (3, 1.0, 2.0)]
    with pytest.raises(Exception, match="rule x"):
        out("raise")
    with pytest.raises(ValueError):
        clean.Constraint(("low",), "like", 1.0)
    with pytest.raises(KeyError):
        clean.consistency_check(p, [clean.Rule("x", (clean.Constraint(("gone",), "le", 1.0),))])


def test_missing_threshold_columns(spark):
    p = Panel(spark.createDataFrame([(D[0], 1.0, None), (D[1], 1.0, None), (D[2], None, 1.0)], "d date, a double, b double"), entity=None)
    assert clean.missing_threshold_filter(p, 0.5).values == ["a"]


def test_features_fail_early_and_never_cross_entities(spark):
    p = Panel(spark.createDataFrame([(D[i], e, v) for e, vs in ((1, (100.0, 110.0, 99.0)), (2, (200.0, 180.0, 198.0))) for i, v in enumerate(vs)], "d date, e long, close double"))
    got = {(r.e, r.d): r.simple_change_close_1 for r in features.build_features(p, [{"op": "simple_change", "column": "close"}]).df.collect()}
    assert got[1, D[0]] is None and got[2, D[0]] is None
    assert np.allclose([got[1, D[1]], got[1, D[2]], got[2, D[1]], got[2, D[2]]], [0.1, -0.1, -0.1, 0.1])
    with pytest.raises(KeyError):
        features.build_features(p, [{"op": "ratio", "numerator": "close", "denominator": "gone"}])
    with pytest.raises(ValueError):
        features.build_features(p, [{"op": "passthrough", "column": "close", "as": "x"}] * 2)


def test_moments_and_guards(spark):
    x = [1.0, 2.0, 4.0, 7.0, 7.5]
    df = spark.createDataFrame([(v, 3.0) for v in x], "x double, c double")
    r = df.agg(skewness_unbiased(F.col("x")).alias("s"), kurtosis_unbiased(F.col("x")).alias("k"), pearson(F.col("x"), F.col("c")).alias("p"), skewness_unbiased(F.col("c")).alias("z")).first()
    assert math.isclose(r.s, pd.Series(x).skew()) and math.isclose(r.k, pd.Series(x).kurt()) and r.p is None and r.z is None
    assert [q.n for q in spark.createDataFrame([("1.5",), ("nan",), ("x",), ("inf",)], "t string").select(number(F.col("t")).alias("n")).collect()] == [1.5, None, None, None]


def test_accounting_identities(spark):
    rng = np.random.default_rng(0)
    rows = [(D[i], e, float(rng.normal()), float(rng.normal(0, 0.02)), 0.0001) for i in range(12) for e in range(5)]
    g = portfolio.weights(spark.createDataFrame(rows, "d date, e long, score double, ret double, rf double"), "d", how="market_neutral")
    daily = portfolio.account(g, "d", "e", 0.001, 0.0, 0.0, 0.0005).orderBy("d").toPandas()
    assert np.allclose(daily.long_contribution + daily.short_contribution + daily.cash_contribution, daily.gross_return)
    assert np.allclose(daily.gross_return - daily.total_cost, daily.net_return) and np.allclose(daily.net_exposure, 0, atol=1e-12) and np.allclose(daily.gross_exposure, 1)
    w = g.toPandas().pivot(index="d", columns="e", values="weight").to_numpy()
    r = g.toPandas().pivot(index="d", columns="e", values="ret").to_numpy()
    after = w * (1 + r) / (1 + (w * r).sum(1) + (1 - w.sum(1)) * 0.0001)[:, None]
    assert np.allclose(daily.l1_turnover, np.abs(w - np.vstack([np.zeros(5), after[:-1]])).sum(1))
    with pytest.raises(Exception, match="-100"):
        spark.createDataFrame([(-2.0,)], "r double").select(portfolio.simple_returns(F.col("r"), "simple")).collect()


def test_rank_bucket_sizes(spark):
    for n, k in ((11, 4), (3, 5), (1, 5), (10, 10)):
        df = spark.range(n).select("id", (F.col("id") * 7 % 13).cast("double").alias("s"))
        b = [r.bucket for r in signals.rank_buckets(df, "s", k, ["id"]).orderBy("s").collect()]
        if n == 1:
            assert b == [None]
        elif n >= k:
            assert b == sorted(b) and set(b) == set(range(1, k + 1)) and max(map(b.count, b)) - min(map(b.count, b)) <= 1
        else:
            assert b == [1, 3, 5]


def test_rolling_spearman(spark):
    x = np.random.default_rng(1).normal(size=(12, 2))
    df = spark.createDataFrame([(D[i], float(a), float(b)) for i, (a, b) in enumerate(x)], "d date, a double, b double")
    got = signals.rolling_pair_correlation(df, "d", "a", "b", 5).orderBy("d").toPandas()
    for i in range(12):
        part = pd.DataFrame(x[max(0, i - 4) : i + 1])
        want = part.corr("spearman").iloc[0, 1] if i >= 4 else math.nan
        assert np.isclose(got.spearman[i], want, equal_nan=True) and np.isclose(got.pearson[i], part.corr().iloc[0, 1] if i >= 4 else math.nan, equal_nan=True)


def test_tails():
    assert math.isclose(inference.student_tail(2.228, 10), 0.05, abs_tol=1e-4) and math.isclose(inference.student_tail(1.0, 1), 0.5, abs_tol=1e-9)
    assert math.isclose(inference.normal_tail(1.959964), 0.05, abs_tol=1e-6)
    for k, x in ((1, 3.841), (2, 5.991), (3, 7.815), (6, 12.592)):
        assert math.isclose(inference.chi2_tail(x, k), 0.05, abs_tol=1e-4)


def test_inference():
    rng = np.random.default_rng(2)
    x = rng.normal(0.3, 1, 500)
    t = inference.hac_mean_test(x, lag=0)
    assert math.isclose(t.statistic, x.mean() / (x.std() / math.sqrt(500)), rel_tol=1e-9)
    test, low, high = inference.sharpe_significance(x, times=300)
    assert low < inference.sharpe(x) < high and test.p_value < 0.2
    up = rng.random(400) < 0.5
    assert inference.pesaran_timmermann(np.where(rng.random(400) < 0.8, up, ~up), up).p_value < 0.001
    f = rng.normal(size=(500, 2))
    y = 0.01 + f @ [0.5, -0.2] + rng.normal(0, 0.01, 500)
    a = inference.factor_alpha(y, f)
    assert np.allclose(a["betas"], [0.5, -0.2], atol=0.01) and math.isclose(a["alpha"], 0.01, abs_tol=0.005) and a["p_value"] < 1e-6
    assert inference.factor_alpha(y[:3], f[:3]) is None
    assert inference.spanning_test(f @ [0.6, 0.4] + rng.normal(0, 0.1, 500), f).p_value > 0.001 > inference.spanning_test(y, f).p_value
    assert inference.joint_alpha_test(np.column_stack([y, y + rng.normal(0, 0.01, 500)]), f).p_value < 1e-6
    assert np.allclose(inference.rolling_betas(y, f, 60)[-1, 1:], [0.5, -0.2], atol=0.02)
    assert inference.diebold_mariano(x**2, x**2 + 1 + rng.normal(0, 0.1, 500)).p_value < 1e-6
    assert inference.sharpe_difference(x, x + 0.001 * rng.normal(size=500), times=100)[1] > 0.05
    loss = rng.normal(size=(300, 3)) + [0, 0, 1]
    p = inference.model_confidence_set(np.column_stack([loss, loss[:, 0]]), 200)
    assert p[2] < 0.05 < p[0] == p[3]


def test_folds(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(i),) for i in range(80)], "d date")
    s = temporal.Splitter(train=30, val=10, test=10, purge=2, step=8)
    got = temporal.folds(df, "d", s).orderBy("fold").collect()
    at = lambda x: (x - dt.date(2020, 1, 1)).days
    assert len(got) == (80 - 54) // 8 + 1 and at(got[-1].test_end) == 79
    for r in got:
        assert at(r.train_end) - at(r.train_start) == 29 and at(r.val_start) - at(r.train_end) == 3 and at(r.test_start) - at(r.val_end) == 3 and at(r.test_end) - at(r.test_start) == 9
    assert temporal.folds(df.limit(20), "d", s).count() == 0
    assert temporal.folds(df, "d", temporal.Splitter(30, 10, 10, 2)).count() == 1
    with pytest.raises(ValueError):
        temporal.check_purge(0, -1)


def loop(values, m, s, half_life):
    lam, out = 2 ** (-1 / half_life), []
    for v in values:
        if v is None:
            out.append(0.0)
            continue
        out.append((v - m) / math.sqrt(max(s, 1e-12)))
        d = v - m
        m, s = m + (1 - lam) * d, lam * (s + (1 - lam) * d * d)
    return out


def test_ewma_batch_and_stream(spark, tmp_path):
    from quantloom.streaming.ewma import standardise

    values = {1: [1.0, None, 2.5, 2.0, 9.0, 1.0], 2: [5.0, 4.0, 6.0, None, 7.0, 5.5]}
    p = Panel(spark.createDataFrame([(D[i], e, v) for e, vs in values.items() for i, v in enumerate(vs)], "d date, e long, x double"))
    got = temporal.ewma_standardise(p, p, "x", 3.0).orderBy("e", "d").collect()
    for e, vs in values.items():
        have = [v for v in vs if v is not None]
        assert np.allclose([r.z for r in got if r.e == e], loop(vs, np.mean(have), np.var(have), 3.0))
    rows = [(e, dt.datetime(2020, 1, i + 1), v) for e, vs in values.items() for i, v in enumerate(vs)]
    schema = "entity long, t timestamp, v double"
    for name, part in (("a", rows[:3] + rows[6:9]), ("b", rows[2:6] + rows[9:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = standardise(stream, 3.0).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sum(r.replayed for r in out) == 1
    for e, vs in values.items():
        fresh = [r.z for r in sorted((r for r in out if r.entity == e and not r.replayed), key=lambda r: r.t)]
        assert np.allclose(fresh, loop(vs, 0.0, 1.0, 3.0))


def test_classifiers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    rows = [(float(a) if i % 17 else None, float(b), int(a + b > 0)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    for kind in ("logistic", "forest"):
        out = models.fit_classifier(df, ["a", "b"], "y", kind, trees=10).score(df).toPandas()
        assert ((out.probability > 0.5) == (out.y == 1)).mean() > 0.85 and out.score.between(-1, 1).all()
    assert models.fit_classifier(df.where("y = 1"), ["a", "b"], "y").score(df).agg(F.max("probability")).first()[0] == 0.5
    with pytest.raises(ValueError):
        models.fit_classifier(df.withColumn("y", F.lit(3)), ["a"], "y")


@pytest.mark.parametrize("how", ["lf", "", (), ("a", "a"), ("",), ("low", "low", "high")])
def test_rules_that_would_do_nothing_or_too_much(how):
    with pytest.raises(ValueError):
        clean.Rule("x", (clean.Constraint(("low",), "le", "high"),), how)


def test_rules_and_constraints_are_checked(spark):
    p = Panel(spark.createDataFrame([(D[0], 1, 5.0, 4.0)], "d date, e long, low double, high double"))
    good = clean.Constraint(("low",), "le", "high")
    for bad in (lambda: clean.Rule("", (good,)), lambda: clean.Rule("x", ()), lambda: clean.Constraint((), "le", 1.0), lambda: clean.Constraint(("a", "a"), "le", 1.0), lambda: clean.Constraint("low", "le", 1.0), lambda: clean.Constraint(("",), "le", 1)):
        with pytest.raises(ValueError):
            bad()
    for odd in (True, None, [1], ("high",)):
        with pytest.raises(TypeError):
            clean.Constraint(("low",), "le", odd)
    with pytest.raises(KeyError):  # a column to blank has to be there before anything is blanked
        clean.consistency_check(p, [clean.Rule("x", (good,), ("low", "gone"))])
    with pytest.raises(KeyError):
        clean.consistency_report(p, [clean.Rule("x", (good,), ("gone",))])
    row = clean.consistency_check(p, [clean.Rule("x", (good,), ("high",))]).df.first()
    assert row.low == 5.0 and row.high is None


def test_evaluated_sample(spark):
    from quantloom.operators import predictions

    scores = spark.createDataFrame([(D[i], i, 0.5) for i in range(4)], "d date, e long, score double")
    labels = spark.createDataFrame([(D[0], 0, 1.0, True), (D[1], 1, 2.0, False), (D[2], 2, math.nan, True), (D[9], 9, 3.0, True)], "d date, e long, y double, seen boolean")
    assert [(r.e, r.y) for r in predictions.evaluated_sample(scores, labels, ["d", "e"], "y", "seen").collect()] == [(0, 1.0)]
    with pytest.raises(ValueError, match="no prediction"):
        predictions.evaluated_sample(scores, labels.where("e > 0"), ["d", "e"], "y", "seen")
    with pytest.raises(ValueError, match="more than one"):
        predictions.evaluated_sample(scores, labels.union(labels), ["d", "e"], "y", "seen")


def test_selection_rule():
    table = {1: [1.0, 1.0, 1.0], 2: [0.9, 0.8, 0.9], 3: [0.2, 1.6, 0.8]}
    pick = lambda c: models.select({"k": 1}, c, lambda c: table[c["k"]])
    assert pick([{"k": 2}])[0] == {"k": 2} and pick([{"k": 3}])[0] == {"k": 1}
    assert len(models.grid({"a": [1, 2], "b": [3, 4]}, {"c": 0})) == 4
    space = {"a": models.choices(1, 2, 3), "r": models.log_range(0.1, 1.0), "n": models.int_range(1, 5)}
    assert models.random_search(space, {}, 5, 7) == models.random_search(space, {}, 5, 7)


def test_latent_factors_are_recovered(spark):
    rng = np.random.default_rng(5)
    f, rows = rng.normal(size=25), []
    for i in range(25):
        z = rng.permutation(40) / 39 - 0.5
        rows += [(D[i], e, float(z[e] * f[i] + rng.normal(0, 0.01)), float(z[e]), float(rng.normal())) for e in range(40)]
    got = latent.estimate(spark.createDataFrame(rows, "d date, e long, r double, z double, noise double"), "d", "e", "r", ["z", "noise"], 1)
    rows = got.factors.orderBy("d").collect()
    assert abs(np.corrcoef([r.factors[0] for r in rows], f)[0, 1]) > 0.99 and [r.d for r in rows] == D[:25]


def test_csv_views(spark, tmp_path):
    path = f"{tmp_path}/x.csv"
    with open(path, "w") as f:
        f.write("date,permno,feature,target\n2020-01-01,1,1.5,7\n2020-01-02,2,bad,8\n2020-01-03,1,,9\n")
    time, entity = ("d", ColumnSpec("date", "date", "yyyy-MM-dd")), ("e", ColumnSpec("permno", "bigint"))
    views = {"a": View(path, time, entity, {"x": ColumnSpec("feature")}, entities=(1,)), "b": View(path, time, all_columns=True, exclude=("permno",), rename={"target": "y"})}
    got = load(spark, views)
    assert [(r.e, r.x) for r in got["a"].df.orderBy("d").collect()] == [(1, 1.5), (1, None)]
    assert got["b"].df.columns == ["d", "feature", "y"] and [r.feature for r in got["b"].df.orderBy("d").collect()] == [1.5, None, None]
    with pytest.raises(KeyError):
        load(spark, {"c": View(path, time, columns={"x": ColumnSpec("gone")})})
    with pytest.raises(TypeError):
        load(spark, {"a": View(path, time, columns={"x": ColumnSpec("target")}), "b": View(path, time, columns={"x": ColumnSpec("target", "bigint")})})
    assert fingerprint(got["a"].df).first() == fingerprint(got["a"].df.orderBy(F.desc("d"))).first()


def test_risk_free_is_causal(spark):
    dates = spark.createDataFrame([(D[i],) for i in (1, 2, 5)], "d date")
    rates = spark.createDataFrame([(D[1], 0.1), (D[4], 0.2)], "d date, rf double")
    assert [r.rf for r in align.align_risk_free(dates, rates, "d").orderBy("d").collect()] == [0.1, 0.1, 0.2]
    with pytest.raises(ValueError):
        align.align_risk_free(dates, rates.where(F.col("d") > D[1]), "d")
    with pytest.raises(ValueError):
        align.align_risk_free(dates, rates.unionByName(rates), "d")


def test_plan_reports_every_mistake_then_runs(spark, tmp_path):
    from quantloom.plans.spec import Plan, cache_key, required_history, run, validate

    for name, header, lines in (("p", "date,id,close", [f"2020-01-{i + 1:02d},{e},{100 + i * e}" for i in range(6) for e in (1, 2)]), ("c", "date,vix", ["2019-12-31,10", "2020-01-03,12"])):
        with open(f"{tmp_path}/{name}.csv", "w") as f:
            f.write("\n".join([header, *lines]) + "\n")
    time, entity = ("d", ColumnSpec("date", "date", "yyyy-MM-dd")), ("e", ColumnSpec("id", "bigint"))
    sources = {"p": View(f"{tmp_path}/p.csv", time, entity, {"close": ColumnSpec("close")}), "c": View(f"{tmp_path}/c.csv", time, columns={"vix": ColumnSpec("vix")}), "unused": View("/nowhere.csv", time)}
    specs = {"p": [{"op": "simple_change", "column": "close", "as": "r"}], "c": [{"op": "passthrough", "column": "vix", "as": "vix"}]}
    plan = Plan(sources, "p", {"p": [("deduplicate", {})]}, specs)
    assert validate(plan) == []
    got = run(spark, plan).df.where("e = 2").orderBy("d").toPandas()
    assert got.vix.isna().sum() == 2 and (got.vix__age.tolist() == [-1, -1, 0, 1, 2, 3]) and math.isclose(got.r[1], 0.02)
    bad = Plan(sources, "gone", {"p": [("nope", {}), ("missing_threshold_filter", {"threshold": 1.0})]}, {"p": [{"op": "x"}, {"op": "ratio", "as": "a"}, {"op": "ratio", "as": "a"}]}, split=temporal.Splitter(3, 1, 1), label_shift=-2, realised={"p": ["a"]}, realisation_lag=1, kinds={"p": "odd"})
    assert len(validate(bad)) == 8
    with pytest.raises(ValueError):
        run(spark, bad)
    assert required_history([{"window": 21, "shift": 1}, {"horizon": 5}]) == 22
    assert cache_key(plan, {"a": "1"}) != cache_key(plan, {"a": "2"})


def test_comparison(spark):
    from quantloom.operators import compare

    rng = np.random.default_rng(8)
    rows = [(m, D[i], float(rng.normal(mu, 0.01)), 0.0) for m, mu in (("a", 0.01), ("b", 0.011), ("c", -0.02)) for i in range(30)]
    daily = spark.createDataFrame(rows, "model string, d date, net_return double, excess_return double").withColumn("excess_return", F.col("net_return"))
    dm = {(r.a, r.b): r.adjusted for r in compare.diebold_mariano_pairs(daily, "model", "d").collect()}
    assert dm["a", "c"] < 0.05 < dm["a", "b"] and compare.sharpe_pairs(daily, "model", "d", times=50).count() == 3
    kept = {r.model: r.in_confidence_set for r in compare.confidence_set(daily, "model", "d", times=200).collect()}
    assert not kept["c"] and kept["b"]
    assert np.allclose(compare.adjusted(np.array([0.01, np.nan, 0.04, 0.03])), [0.03, np.nan, 0.06, 0.06], equal_nan=True)
    tests = spark.createDataFrame([("a", D[0], D[9]), ("b", D[3], D[12])], "model string, start date, end date")
    assert compare.comparison_window(tests) == (D[3], D[9]) and compare.comparison_window(tests, D[5]) == (D[3], D[5])
    with pytest.raises(ValueError):
        compare.comparison_window(tests, D[1])
    base = {k: 0.0 for k in compare.ACCOUNTING}
    compare.check_accounting({"a": base | {"leverage": 1}, "b": base | {"leverage": 2}})
    with pytest.raises(ValueError):
        compare.check_accounting({"a": base, "b": base | {"fee": 0.1}})
    with pytest.raises(ValueError):
        compare.check_realisation_lag({"a": 1, "b": 2}, 1)
    long = compare.long_metrics(daily.agg(F.avg("net_return").alias("mean_return")), "a")
    assert compare.metric_table(long).columns == ["model", "mean_return"] and compare.publication_table(long, ["mean_return"]).first().title == "Mean Return"


def test_prediction_contract(spark):
    from quantloom.operators import predictions

    rows = [(D[0], 1, 0.5, {"a": 0.4, "b": 0.6}, {0.1: 1.0, 0.9: 2.0}), (D[0], 1, float("nan"), {"a": 0.7, "b": 0.6}, {0.1: 3.0, 0.9: 2.0}), (D[1], 1, 0.1, {"a": 1.0}, {0.5: 1.0})]
    df = spark.createDataFrame(rows, "d date, e long, score double, p map<string,double>, q map<double,double>")
    assert tuple(predictions.prediction_errors(df, ["d", "e"], "multiclass", probabilities="p", quantiles="q").first()) == (1, 1, 1, 1)
    a = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.2)], "e long, t double")
    b = spark.createDataFrame([(1, 0.5), (3, 0.2), (4, 0.1)], "e long, t double")
    assert sorted(r.e for r in predictions.common_sample([a, b], ["e"], "t").collect()) == [1, 3]
    with pytest.raises(ValueError):
        predictions.common_sample([a, b.withColumn("t", F.col("t") + 1)], ["e"], "t")
    assert predictions.same_observations(a, a, ["e"]) and not predictions.same_observations(a, b, ["e"])


def test_ewma_over_a_long_history(spark):
    """Blocks of powers give what the plain recursion gives, with gaps, over batches and many half-lives."""
    import numpy as np

    from quantloom.operators import temporal
    from quantloom.panel import Panel

    rng = np.random.default_rng(3)
    rows = [(e, k, None if rng.random() < 0.1 else float(rng.normal(e, 2))) for e in (1, 2) for k in range(25_000)]
    p = Panel(spark.createDataFrame(rows, "e int, d int, x double"), time="d", entity="e")
    got = {(r.e, r.d): r.z for r in temporal.ewma_standardise(p, p, "x", 3.0).collect()}
    lam = temporal.decay(3.0)
    for e in (1, 2):
        seen = np.array([x for a, _, x in rows if a == e and x is not None])
        m, s = seen.mean(), seen.var()
        for a, k, x in rows:
            if a != e:
                continue
            want = 0.0
            if x is not None:
                want, d = (x - m) / np.sqrt(max(s, 1e-12)), x - m
                m, s = m + (1 - lam) * d, lam * (s + (1 - lam) * d * d)
            assert abs(got[e, k] - want) < 1e-6


def test_running_totals_over_ranges(spark):
    from pyspark.sql import functions as F

    from quantloom.operators import signals

    d = spark.range(5000).select((F.xxhash64("id") / 1e15).alias("s"), (F.col("id") % 7).alias("n"))
    for down in (False, True):
        total = 0
        for r in sorted(signals.running(d, "s", ["n"], down, parts=13).collect(), reverse=down):
            assert r.n_before == total
            total += r.n
    assert signals.running(d.limit(0), "s", ["n"]).count() == 0


def test_evaluations_hold_every_table(spark, sf):
    from quantloom.operators import portfolio, signals
    from quantloom.plans import portfolios, signal_queries

    tables = portfolio.evaluate(portfolios.weighted(spark, sf), "d", "e", rolling=5, fee=0.001)
    assert tables["net"].count() == 1 and tables["sides"].count() == 5 and tables["legs"].count() == 2
    tables = signals.evaluate(signal_queries.panel(spark, sf), "d", "e", "score", "target", window=5, leads=(1, 2))
    assert tables["decay"].count() == 2 and tables["headline"].count() == 1 and tables["monotonicity"].count() == 1
    import pytest

    with pytest.raises(ValueError):
        portfolio.check_reconciliation(portfolios.daily(spark, sf).withColumn("net_return", F.col("net_return") + 1e-6))
