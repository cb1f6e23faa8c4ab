"""Factor sections of many models, and what is read for them."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import factor_analysis as fa
from quantloom.operators import inference
from quantloom.operators.clean import Constraint, Rule
from quantloom.panel import Panel
from quantloom.plans import requirements as rq
from quantloom.plans.spec import Plan, run
from quantloom.sources import ColumnSpec, View

DAY = dt.date(2020, 1, 1)
SETTINGS = {"factors": ["mkt", "smb"], "market": "mkt", "benchmarks": ["p1", "p2"], "instruments": ["z"], "window": 30}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(12)
    n = 200
    f, z, e = rng.normal(size=(n, 2)), rng.normal(size=n), rng.normal(size=(n, 2))
    bench = 100 * (f @ [[1.0, 0.4], [0.1, 0.8]] + 0.3 * rng.normal(size=(n, 2)))
    days = [DAY + dt.timedelta(i) for i in range(n)]
    y = {m: 0.05 * k + f @ [0.8, -0.1] + e[:, k] * 0.4 for k, m in enumerate("ab")}
    frame = lambda names, x: Panel(spark.createDataFrame([(d, *map(float, r)) for d, r in zip(days, x)], f"d date, {', '.join(c + ' double' for c in names)}"), entity=None)
    daily = spark.createDataFrame([(m, d, float(v)) for m in y for d, v in zip(days, y[m])], "model string, d date, x double")
    panels = frame(["mkt", "smb"], f), frame(["p1", "p2"], bench), frame(["z"], z[:, None])
    return y, f, bench, daily, panels, spark.createDataFrame([(DAY - dt.timedelta(1), 0.001)], "d date, rf double")


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)


def test_whole_section(data):
    y, f, bench, daily, (factors, benchmarks, instruments), rf = data
    design = fa.design_of(SETTINGS)
    series = fa.series_for(design, factors, benchmarks, instruments, rf)
    latent = factors.df.select("d", F.col("smb").alias("l1"))
    found = fa.analyse(daily, "model", "x", design, series, latent)
    assert set(found.tables) == {"alpha", "rolling", "cumulative", "differences", "joint", "timing", "spanning", "latent_alpha"}
    want = {m: inference.factor_alpha(y[m], f) for m in y}
    tables = fa.section(found, "model")
    cells = {(r.model, r.statistic): r for r in tables["alpha"].collect()}
    assert len(cells) == 8 and [s for _, s in sorted((r.position, r.statistic) for r in cells.values() if r.model == "a")] == ["annualized_alpha", "mkt", "smb", "r_squared"]
    for m in y:
        assert close(cells[m, "annualized_alpha"].value, want[m]["annualized_alpha"]) and close(cells[m, "annualized_alpha"].p_value, want[m]["p_value"])
        assert close(cells[m, "smb"].value, want[m]["betas"][1]) and close(cells[m, "r_squared"].value, want[m]["r_squared"]) and cells[m, "r_squared"].p_value is None
    span = {r.of: r for r in tables["tests"].collect()}
    assert close(span["a"].statistic, inference.spanning_test(y["a"], bench * 0.01 - 0.001).statistic)
    assert math.isclose(span["all"].statistic, inference.joint_alpha_test(np.column_stack([y["a"], y["b"]]), f).statistic, rel_tol=1e-6)
    terms = [r.statistic for r in tables["timing"].where("model = 'a'").orderBy("position").collect()]
    assert terms == ["annualized_alpha", "alpha_z", "mkt", "mkt_x_z", "smb", "mkt_squared", "r_squared"]
    assert tables["latent_alpha"].where("statistic = 'l1'").count() == 2 and found.tables["differences"].first().adjusted is not None
    assert found.tables["rolling"].count() == 2 * 171 and found.tables["cumulative"].count() == 400


def test_one_model_and_fewer_series(data):
    y, f, _, daily, (factors, _, _), _ = data
    design = fa.Design(("mkt", "smb"), "mkt", window=30, correction="none")
    found = fa.analyse(daily.where("model = 'a'"), "model", "x", design, fa.series_for(design, factors))
    assert set(found.tables) == {"alpha", "rolling", "cumulative", "differences", "joint"} and found.tables["differences"].count() == 0
    assert fa.section(found, "model")["tests"].count() == 0


@pytest.mark.parametrize("bad", [{"market": "x"}, {"factors": []}, {"window": 3}, {"instruments": ["mkt"]}, {"scale": 0.0}, {"correction": "odd"}, {"lag": -1}, {"more": 1}])
def test_settings_that_are_refused(bad):
    with pytest.raises(ValueError):
        fa.design_of(SETTINGS | bad)


def test_series_that_are_refused(data):
    *_, daily, (factors, benchmarks, instruments), rf = data
    design = fa.design_of(SETTINGS)
    for args in ((Panel(factors.df.withColumn("e", F.lit(1))), benchmarks, instruments, rf), (factors.with_df(factors.df.drop("smb")), benchmarks, instruments, rf), (factors, None, instruments, rf), (factors, benchmarks, None, rf), (factors, benchmarks, instruments, None), (factors, benchmarks, instruments, rf.where("rf > 1"))):
        with pytest.raises(ValueError):
            fa.series_for(design, *args)


TIME, ENTITY = ("d", ColumnSpec("date", "date", "yyyy-MM-dd")), ("e", ColumnSpec("id", "bigint"))


def plan_of(folder):
    sources = {
        "prices": View(f"{folder}/p.csv", TIME, ENTITY, {"close": ColumnSpec("close"), "volume": ColumnSpec("volume"), "open": ColumnSpec("open")}, entities=(1, 2, 3)),
        "labels": View(f"{folder}/p.csv", TIME, ENTITY, {"close": ColumnSpec("close")}), "macro": View(f"{folder}/m.csv", TIME, columns={"vix": ColumnSpec("vix"), "rf": ColumnSpec("rf")}),
        "gone": View("/nowhere.csv", TIME, columns={"x": ColumnSpec("x")}), "wide": View(f"{folder}/m.csv", TIME, all_columns=True, rename={"vix": "fear"}),
    }
    steps = {"prices": [("consistency_check", {"rules": [Rule("positive", (Constraint(("open",), "gt", 0),))]})], "labels": [("deduplicate", {})]}
    specs = {"prices": [{"op": "log_change", "column": "close", "horizon": 5, "as": "mom"}, {"op": "rolling_volatility", "column": "close", "window": 20, "shift": 1, "as": "vol"}, {"op": "passthrough", "column": "volume", "as": "vlm"}], "labels": [{"op": "simple_change", "column": "close", "shift": -1, "as": "fwd"}], "macro": [{"op": "passthrough", "column": "vix", "as": "vix"}]}
    return Plan(sources, "prices", steps, specs)


def test_only_what_is_needed_is_read():
    plan = plan_of("/f")
    needs = rq.model_needs({"features": "prices", "context": ["macro"], "supervision": ("labels", "fwd"), "target": 2})
    found = rq.close(plan, needs)
    assert set(found) == {"prices", "labels", "macro"} and found["prices"].view.entities == (2,) == found["labels"].view.entities and found["macro"].view.entities is None
    assert rq.files(found) == {"/f/p.csv": {"date", "id", "close", "volume", "open"}, "/f/m.csv": {"date", "vix"}}
    assert found["prices"].history == 21 and len(found["prices"].features) == 3
    one = rq.close(plan, [rq.Need("prices", ("mom",))])
    assert set(one["prices"].view.columns) == {"close", "open"} and [s["as"] for s in one["prices"].features] == ["mom"]  # what the cleaning looks at stays
    assert rq.files(rq.close(plan, [rq.Need("wide", ("fear",))]))["/f/m.csv"] == {"date", "vix"} and "*" in rq.files(rq.close(plan, [rq.Need("wide")]))["/f/m.csv"]


def test_needs_that_cannot_be_met():
    plan = plan_of("/f")
    with pytest.raises(ValueError) as e:
        rq.close(plan, [rq.Need("none"), rq.Need("prices", ("beta",)), rq.Need("prices", ("mom",), (9,))])
    assert str(e.value) == "no dataset none; prices has no ['beta']; prices leaves out [9]"
    for bad in ({"features": "prices", "target": 1, "universe": [1]}, {"features": "prices", "odd": 1}):
        with pytest.raises(ValueError):
            rq.model_needs(bad)


def test_needs_of_analyses():
    needs, view = rq.analytics_needs(("macro", "rf"), ("ff", ["mkt"]), None, ("macro", ["vix"]))
    assert view == "features" and needs == [rq.Need("macro", ("rf",)), rq.Need("ff", ("mkt",)), rq.Need("macro", ("vix",))]
    needs, view = rq.analytics_needs(("macro", "rf"), latent={"aligning": "prices", "returns": ("labels", "fwd"), "characteristics": "prices"})
    assert view == "aligned" and [n.dataset for n in needs] == ["macro", "prices", "labels", "prices"]


def test_a_narrowed_plan_runs(spark, tmp_path):
    for name, lines in (("p", ["date,id,close,volume,open"] + [f"2020-01-{i:02d},{e},{100 + i * e},5,1" for i in range(1, 28) for e in (1, 2, 3, 4)]), ("m", ["date,vix,rf", "2020-01-01,10,0"])):
        with open(f"{tmp_path}/{name}.csv", "w") as f:
            f.write("\n".join(lines) + "\n")
    plan = plan_of(str(tmp_path))
    narrow = rq.narrowed(plan, rq.model_needs({"features": "prices", "context": ["macro"], "universe": [1, 3]}))
    got = run(spark, narrow).df
    assert {r.e for r in got.select("e").distinct().collect()} == {1, 3} and {"mom", "vol", "vlm", "vix"} <= set(got.columns) and got.count() == 54


def test_a_table_is_planned_when_it_is_asked_for(data, monkeypatch):
    """Pairs of models grow with the square of the models; who wants the alphas alone must not pay for them."""
    _, _, _, daily, (factors, benchmarks, instruments), rf = data
    asked = []
    for name in ("alpha_difference", "joint_alpha_test", "spanning_test", "timing_model", "rolling_betas", "cumulative_alpha"):
        monkeypatch.setattr(fa.st, name, lambda *a, _n=name, **k: asked.append(_n))
    design = fa.design_of(SETTINGS)
    found = fa.analyse(daily, "model", "x", design, fa.series_for(design, factors, benchmarks, instruments, rf))
    tables = fa.section(found, "model")
    assert "differences" in found.tables and "timing" in tables and set(tables) == {"alpha", "timing", "tests"}
    assert tables["alpha"].count() == 8 and tables["alpha"] is tables["alpha"] and asked == []
