"""Runs that are killed, owned by others, or begun with something else."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import temporal
from quantloom.plans import execution as ex

DAY = dt.date(2020, 1, 1)
SPLIT = temporal.Splitter(train=6, val=2, test=2, step=2)


@pytest.fixture
def panel(spark):
    return spark.range(14).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("d"), F.col("id").alias("x"))


def run_of(spark, tmp_path, **kw):
    return ex.Run(spark, f"{tmp_path}/runs", **({"name": "r1", "plan": {"model": "mean", "sizes": [6, 2, 2]}, "sources": {"panel": "digest-1"}, "code": "v1"} | kw))


def phases(calls, fail_at=None):
    def step(name, f):
        def go(t):
            calls.append(name)
            if (name, calls.count(name)) == fail_at:
                raise KeyboardInterrupt(name)
            return f(t)

        return go

    fit = step("fit", lambda t: {"model": t["prepare.train"].agg(F.avg("x").alias("mean"))})
    predict = step("predict", lambda t: {"scores": t["prepare.test"].crossJoin(t["fit.model"])})
    evaluate = step("evaluate", lambda t: {"metrics": t["predict.scores"].agg(F.avg(F.abs(F.col("x") - F.col("mean"))).alias("mae"))})
    return fit, predict, evaluate


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path, panel):
    calls = []
    with pytest.raises(KeyboardInterrupt), run_of(spark, tmp_path) as run:
        ex.walk_forward(run, panel, "d", SPLIT, *phases(calls, ("predict", 2)))
    assert calls == ["fit", "predict", "evaluate", "fit", "predict"]
    assert ex.to_resume(spark, f"{tmp_path}/runs") == "r1"
    with run_of(spark, tmp_path) as run:
        again = []
        out = ex.walk_forward(run, panel, "d", SPLIT, *phases(again))
        assert again == ["predict", "evaluate", "fit", "predict", "evaluate"]  # the second fold's model was there
        assert sorted(out) == [0, 1, 2] and [out[k]["evaluate.metrics"].first().mae for k in out] == [6.0] * 3
        events = run.ledger()
        assert [e["event"] for e in events].count("failed") == 1 and events[-1]["rows"] == {"metrics": 1}
        assert set(ex.status(events).values()) == {"ended", "reused"}
    assert ex.to_resume(spark, f"{tmp_path}/runs") is None
    with pytest.raises(ex.RunError, match="nothing to go on"):
        ex.to_resume(spark, f"{tmp_path}/runs", "r1")


def test_a_second_owner_is_refused(spark, tmp_path):
    with run_of(spark, tmp_path) as first:
        with pytest.raises(ex.RunError, match=first.owner), run_of(spark, tmp_path):
            pass
        assert first.holder() == first.owner  # the one refused doesn't give back what it never had
        other = run_of(spark, tmp_path)
        with pytest.raises(ex.RunError):
            other.acquire(instead_of="someone else")
        other.acquire(instead_of=first.owner)
        with pytest.raises(ex.RunError, match="held by"):
            first.phase(0, "x", lambda: {})
        first.release()
        assert other.holder() == other.owner
        other.release()
    with run_of(spark, tmp_path):
        pass
    assert run_of(spark, tmp_path).holder() is None


@pytest.mark.parametrize("change, where", [({"sources": {"panel": "digest-2"}}, "sources.panel"), ({"code": "v2"}, "code"), ({"plan": {"model": "median", "sizes": [6, 2, 2]}}, "plan"), ({"sources": {"panel": "digest-1", "more": "x"}}, "sources.more")])
def test_something_else_is_refused(spark, tmp_path, change, where):
    with run_of(spark, tmp_path):
        pass
    with pytest.raises(ex.RunError, match=where.replace(".", r"\.")), run_of(spark, tmp_path, **change):
        pass
    assert run_of(spark, tmp_path).holder() is None


def test_which_run_to_resume(spark, tmp_path):
    for name in ("a", "b"):
        with pytest.raises(ZeroDivisionError), run_of(spark, tmp_path, name=name) as run:
            run.phase(0, "fit", lambda: 1 / 0)
    with pytest.raises(ex.RunError, match="several"):
        ex.to_resume(spark, f"{tmp_path}/runs")
    assert ex.to_resume(spark, f"{tmp_path}/runs", "b") == "b" and ex.to_resume(spark, f"{tmp_path}/none") is None
    with pytest.raises(ValueError):
        run_of(spark, tmp_path, name="a/b")
    with pytest.raises(ValueError), run_of(spark, tmp_path, name="c") as run:
        run.execute(spark.createDataFrame([(0,)], "fold int"), [("x", None), ("x", None)])
