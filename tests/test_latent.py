"""Factor estimation in tasks against the same least squares on whole matrices, and its sample selection."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import latent

DAY = dt.date(2022, 1, 3)
COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def simulated():
    """30 dates of 25 to 40 entities, two factors on three characteristics; some values are missing."""
    rng = np.random.default_rng(11)
    gamma, f, rows = np.linalg.qr(rng.normal(size=(4, 2)))[0], rng.normal(size=(30, 2)) * [2, 1], []
    for t in range(30):
        n = 25 + t % 16
        x = rng.normal(size=(n, 3))
        z = np.column_stack([(x.argsort(axis=0).argsort(axis=0)) / (n - 1) - 0.5, np.ones(n)])
        r = z @ gamma @ f[t] + rng.normal(0, 0.02, n)
        x[rng.random((n, 3)) < 0.03] = np.nan
        rows += [(DAY + dt.timedelta(t), e, float(r[e]), *[None if math.isnan(v) else float(v) for v in x[e]]) for e in range(n)]
    return rows, f


def plain(rows, k):
    """Alternating least squares on stacked rows, without cross products."""
    z, y, dates = [], [], sorted({r[0] for r in rows})
    for d in dates:
        own = [r for r in rows if r[0] == d and r[2] is not None and sum(v is not None for v in r[3:]) >= 1.5]
        cols = []
        for j in range(3, 6):
            there = [r[j] for r in own if r[j] is not None]
            cols.append([0.0 if r[j] is None else (sum(v < r[j] for v in there) + (sum(v == r[j] for v in there) - 1) / 2) / (len(there) - 1) - 0.5 for r in own])
        z.append(np.column_stack([*map(np.array, cols), np.ones(len(own))]))
        y.append(np.array([r[2] for r in own]))
    gamma = np.linalg.svd(np.array([a.T @ b for a, b in zip(z, y)]).T)[0][:, :k]
    for _ in range(300):
        f = [np.linalg.lstsq(a @ gamma, b, rcond=None)[0] for a, b in zip(z, y)]
        design = np.concatenate([np.einsum("ni,k->nik", a, g).reshape(len(a), -1) for a, g in zip(z, f)])
        gamma = np.linalg.qr(np.linalg.lstsq(design, np.concatenate(y), rcond=None)[0].reshape(4, k))[0]
    return gamma, np.array([np.linalg.lstsq(a @ gamma, b, rcond=None)[0] for a, b in zip(z, y)])


def frame(spark, rows):
    return spark.createDataFrame(rows, "d date, e long, r double, a double, b double, c double")


def test_same_as_on_whole_matrices(spark, simulated):
    rows, f = simulated
    gamma, want = plain(rows, 2)
    got = latent.estimate(frame(spark, rows).repartition(7), "d", "e", "r", COLUMNS, 2)
    assert np.allclose(got.loadings @ got.loadings.T, gamma @ gamma.T, atol=1e-5) and np.allclose(got.loadings.T @ got.loadings, np.eye(2), atol=1e-9)
    realised = np.array([r.factors for r in got.factors.orderBy("d").collect()])
    assert np.allclose(realised @ got.loadings.T, want @ gamma.T, atol=1e-4)
    fit = np.linalg.lstsq(np.column_stack([realised, np.ones(30)]), f, rcond=None)
    assert (fit[1] / ((f - f.mean(axis=0)) ** 2).sum(axis=0) < 0.02).all()
    again = latent.estimate(frame(spark, rows).repartition(30), "d", "e", "r", COLUMNS, 2)  # sums by way of a few tasks
    assert np.allclose(again.loadings, got.loadings, atol=1e-6)


def test_audit_of_the_sample(spark, simulated):
    rows = list(simulated[0])
    first = [r for r in rows if r[0] == DAY]
    rows.remove(first[0])
    rows.append((DAY, first[0][1], None, 1.0, 1.0, 1.0))
    rows += [(DAY, 900, 0.1, None, None, None), (DAY, 901, 0.1, 1.0, None, None)]
    thin, flat = DAY + dt.timedelta(100), DAY + dt.timedelta(101)
    rows += [(thin, e, 0.1, float(e), 1.0, 2.0) for e in range(2)] + [(flat, e, 0.1, 1.0, 1.0, 1.0) for e in range(9)]
    df = frame(spark, rows).withColumns({"twice": F.col("a") * 2, "same": F.lit(4.0), "a__age": F.when((F.col("e") == 3) & (F.col("d") == DAY), 9).otherwise(1), "inf": F.lit(math.inf)}).withColumn("twice__age", F.col("a__age"))
    got = latent.estimate(df, "d", "e", "r", [*COLUMNS, "twice", "same"], 2, max_age={"columns": {"a": 5, "twice": 5}})
    a = got.audit
    assert a["input_rows"] == len(rows) and a["input_dates"] == 32 and a["missing_return"] == 1 and a["thin_dates"] == 1 and a["thin_date_rows"] == 2
    assert a["no_characteristic"] == 0 and a["low_coverage"] >= 1 and a["rank_deficient_dates"] == 1 and a["rank_deficient_rows"] == 9
    assert a["used"] == COLUMNS and a["left_out"] == {"twice": "follows from others", "same": "does not vary"}
    assert a["stale"] == {"a": 1, "b": 0, "c": 0, "twice": 1, "same": 0} and a["max_age"] == {"a": 5, "twice": 5} and a["estimation_dates"] == 30
    assert a["input_rows"] == a["missing_return"] + a["no_characteristic"] + a["low_coverage"] + a["thin_date_rows"] + a["rank_deficient_rows"] + a["estimation_rows"]
    assert got.used == [*COLUMNS, "constant"]


def test_what_cannot_be_estimated(spark, simulated):
    df = frame(spark, simulated[0])
    for bad in (dict(k=5), dict(columns=[]), dict(columns=["a", "a"]), dict(max_age=3), dict(max_age={"z": 1}), dict(max_age={"a": -1}), dict(max_age={"a": True}), dict(max_age={"default": 1, "other": 2}), dict(k=60), dict(max_age={"columns": 3})):
        with pytest.raises(ValueError):
            latent.estimate(df, "d", "e", "r", bad.pop("columns", COLUMNS), bad.pop("k", 1), **bad)
    with pytest.raises(ValueError, match="more than one row"):
        latent.estimate(df.union(df), "d", "e", "r", COLUMNS, 1)
    with pytest.raises(ValueError, match="no row"):
        latent.estimate(df.withColumn("r", F.lit(math.nan)), "d", "e", "r", COLUMNS, 1)
    assert latent.age_limits(COLUMNS, {"default": 4, "columns": {"b": 1}}) == {"a": 4, "b": 1, "c": 4}


def test_panel_preparation(spark):
    rows = [(DAY, 1, 0.1, True, 1.0), (DAY, 2, 0.2, False, 2.0), (DAY, 3, math.inf, True, None), (DAY + dt.timedelta(1), 1, -0.1, True, math.nan), (DAY + dt.timedelta(9), 1, 0.3, True, 1.0)]
    df = spark.createDataFrame(rows, "d date, e long, r double, seen boolean, x double").withColumn("x__age", F.lit(2))
    rates = spark.createDataFrame([(DAY - dt.timedelta(3), 0.01), (DAY + dt.timedelta(1), 0.02)], "d date, rf double")
    got = {(r.d, r.e): r for r in latent.prepare_panel(df, "d", "e", "r", "seen", ["x"], DAY, DAY + dt.timedelta(5), "log", rates).collect()}
    assert len(got) == 4 and math.isclose(got[DAY, 1].r, math.expm1(0.1) - 0.01) and math.isclose(got[DAY + dt.timedelta(1), 1].r, math.expm1(-0.1) - 0.02)
    assert got[DAY, 2].r is None and got[DAY, 3].r is None and got[DAY + dt.timedelta(1), 1].x is None and got[DAY, 1].x__age == 2
    audit = latent.panel_audit(latent.prepare_panel(df, "d", "e", "r", "seen", ["x"], DAY, DAY + dt.timedelta(5)), "d", "e", "r", ["x"]).first()
    assert (audit.grid_rows, audit.observed_returns, audit.rejected_returns, audit.entities) == (4, 2, 2, 3) and audit.non_missing == {"x": 0.5} and audit.daily_coverage[0] == 0
    for bad in (dict(start=DAY + dt.timedelta(50)), dict(columns=[]), dict(return_type="odd"), dict(risk_free=rates.where("rf > 0.015"))):
        with pytest.raises(ValueError):
            latent.prepare_panel(df, "d", "e", "r", "seen", bad.pop("columns", ["x"]), bad.pop("start", DAY), DAY + dt.timedelta(90), **bad)
