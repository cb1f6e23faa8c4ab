"""Queries of splits, sequences, standardisation, baselines, and of operators that SQL can't express."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import latent, models, predictions, temporal, tuning
from ..operators import signals as sg
from ..operators.align import dense_grid
from ..panel import Panel
from .registry import GRID, SUP, USR, grid, r, register, shown, sup, table, usr

DAYS = f"{SUP}, days AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS n, count(*) OVER () AS total FROM (SELECT DISTINCT d FROM sup))"
SPLIT = temporal.Splitter(train=300, val=60, test=100, purge=5, step=100)
FOLDS = f"""{DAYS}, k AS (SELECT max(total) AS total, CAST((max(total) - {SPLIT.block}) // {SPLIT.step} + 1 AS BIGINT) AS many FROM days), f AS (SELECT fold, total - {SPLIT.block} - (many - 1 - fold) * {SPLIT.step} AS first FROM k, unnest(range(many)) AS u(fold)),
folds AS (SELECT fold, max(d) FILTER (n = first) AS train_start, max(d) FILTER (n = first + 299) AS train_end, max(d) FILTER (n = first + 305) AS val_start, max(d) FILTER (n = first + 364) AS val_end, max(d) FILTER (n = first + 370) AS test_start, max(d) FILTER (n = first + 469) AS test_end FROM f, days GROUP BY fold)"""


def split(spark, folder):
    return temporal.folds(sup(spark, folder), "d", SPLIT)


@register("split_walk_forward", f"WITH {FOLDS} SELECT * FROM folds")
def walk_forward(spark, folder):
    return split(spark, folder).withColumn("fold", F.col("fold").cast("long"))


@register("split_assign", f"WITH {FOLDS}, a AS (SELECT fold, CASE WHEN d BETWEEN train_start AND train_end THEN 'train' WHEN d BETWEEN val_start AND val_end THEN 'val' WHEN d BETWEEN test_start AND test_end THEN 'test' END AS part FROM sup, folds WHERE d BETWEEN train_start AND test_end) SELECT fold, part, count(*) AS n FROM a WHERE part IS NOT NULL GROUP BY 1, 2")
def assign(spark, folder):
    return temporal.assign(sup(spark, folder), "d", split(spark, folder)).groupBy(F.col("fold").cast("long").alias("fold"), "part").agg(F.count("*").alias("n"))


@register("split_window_with_history", f"WITH {DAYS} SELECT d, e, {r('close', 'close')} FROM sup WHERE d IN (SELECT d FROM days WHERE n >= (SELECT min(n) - 20 FROM days WHERE d >= DATE '1997-06-01') AND d <= DATE '1997-08-01')")
def history(spark, folder):
    return shown(temporal.window_with_history(sup(spark, folder).select("d", "e", "close"), "d", "1997-06-01", "1997-08-01", 20))


@register("date_batches", f"WITH {DAYS} SELECT n // 50 AS batch, count(*) AS rows, count(DISTINCT e) AS entities FROM sup JOIN days USING (d) GROUP BY 1")
def date_batches(spark, folder):
    return temporal.date_batches(sup(spark, folder), "d", 50).groupBy("batch").agg(F.count("*").alias("rows"), F.countDistinct("e").alias("entities"))


@register("sequences", f"""WITH {USR}, days AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT d FROM usr)), j AS (SELECT usr.*, n - row_number() OVER (PARTITION BY e ORDER BY d) AS run FROM usr JOIN days USING (d)),
c AS (SELECT d, e, count(*) OVER w AS k, sum(v) OVER w AS total FROM j WINDOW w AS (PARTITION BY e, run ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT d, e, k AS length, {r('total', 'total')} FROM c WHERE k = 4""")  # fmt: skip
def sequences(spark, folder):
    p = Panel(usr(spark, folder).select("d", "e", "v").withColumn("segment", F.lit(0)))
    s = temporal.build_sequences(p, ["v"], 3, 1)
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x["v"])
    return shown(s.select("d", "e", F.size("sequence").alias("length"), total.alias("total")))


@register("ewma_prior", f"WITH {USR} SELECT e, {r('avg(v)', 'v__mean')}, {r('var_pop(v)', 'v__var')} FROM usr GROUP BY e")
def ewma_prior(spark, folder):
    return shown(temporal.ewma_prior(Panel(usr(spark, folder).select("d", "e", "v")), ["v"])[0])


@register("ewma_standardise", f"""WITH RECURSIVE {GRID}, o AS (SELECT d, e, v, row_number() OVER (PARTITION BY e ORDER BY d) AS n FROM grid), pri AS (SELECT e, coalesce(avg(v), (SELECT avg(v) FROM grid), 0) AS m, coalesce(var_pop(v), (SELECT var_pop(v) FROM grid), 0) AS s FROM grid GROUP BY e), k AS (SELECT pow(2, -0.1) AS lam),
st AS (SELECT e, CAST(0 AS BIGINT) AS n, CAST(m AS DOUBLE) AS m, CAST(s AS DOUBLE) AS s, CAST(NULL AS DATE) AS d, CAST(0 AS DOUBLE) AS z FROM pri UNION ALL
 SELECT o.e, o.n, CASE WHEN o.v IS NULL THEN st.m ELSE st.m + (1 - lam) * (o.v - st.m) END, CASE WHEN o.v IS NULL THEN st.s ELSE lam * (st.s + (1 - lam) * (o.v - st.m) * (o.v - st.m)) END, o.d, CASE WHEN o.v IS NULL THEN 0 ELSE (o.v - st.m) / sqrt(greatest(st.s, 1e-12)) END FROM st JOIN o ON o.e = st.e AND o.n = st.n + 1, k)
SELECT d, e, {r('z', 'z')} FROM st WHERE n > 0""")  # fmt: skip
def ewma_standardise(spark, folder):
    p = Panel(dense_grid(usr(spark, folder).select("d", "e", "v"), "d", "e"))
    return shown(temporal.ewma_standardise(p, p, "v", 10.0))


@register("model_equal_weight", f"WITH {SUP} SELECT d, e, CAST(1 AS DOUBLE) AS score FROM sup WHERE sparse IS NOT NULL")
def equal_weight(spark, folder):
    return models.equal_weight(sup(spark, folder).select("d", "e", "sparse"), ["sparse"]).select("d", "e", "score")


@register("model_inverse_volatility", f"WITH {SUP}, v AS (SELECT d, e, stddev_samp(close) OVER (PARTITION BY e ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS vol FROM sup) SELECT d, e, {r('1000 / greatest(vol, 1e-8)', 'score')} FROM v WHERE vol > 0")
def inverse_volatility(spark, folder):
    p = Panel(sup(spark, folder))
    v = p.df.select("d", "e", F.stddev_samp("close").over(p.trailing(5)).alias("vol"))
    return shown(models.inverse_volatility(v, "vol").select("d", "e", (1000 * F.col("score")).alias("score")))


@register("model_losses", "SELECT round(avg((l_discount - l_tax) * (l_discount - l_tax)), 6) + 0.0 AS mse, round(avg(abs(l_discount - l_tax)), 6) + 0.0 AS mae FROM lineitem")
def losses(spark, folder):
    return shown(models.losses(table(spark, folder, "lineitem"), "l_discount", "l_tax").select("mse", "mae"))


#: 13 strengths times 7 shares of the absolute part.
PENALTIES = [(10 ** (k / 2 - 4), share) for k in range(13) for share in (0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0)]
_CAND = ", ".join(f"({i}, CAST({s!r} AS DOUBLE), CAST({t!r} AS DOUBLE))" for i, (s, t) in enumerate(PENALTIES))


@register("elastic_net_fold_scores", f"""WITH {FOLDS}, ca(candidate, strength, share) AS (VALUES {_CAND}), rw AS (SELECT fold, CASE WHEN d BETWEEN train_start AND train_end THEN 1 WHEN d BETWEEN val_start AND val_end THEN 0 END AS t, volume / 25 AS x, close / 40000 AS y FROM sup, folds WHERE d BETWEEN train_start AND val_end),
tr AS (SELECT fold, count(*) AS n_train, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) AS c FROM rw WHERE t = 1 GROUP BY 1),
be AS (SELECT *, sign(c) * greatest(abs(c / sx) - strength * share, 0) / (1 + strength * (1 - share)) / sx AS b FROM tr, ca)
SELECT fold, CAST(candidate AS BIGINT) AS candidate, n_train, count(*) AS n_val, {r('max(b)', 'slope')}, {r('max(my - b * mx)', 'intercept')}, {r('avg((y - my - b * (x - mx)) * (y - my - b * (x - mx)))', 'loss')} FROM be JOIN rw USING (fold) WHERE t = 0 GROUP BY 1, 2, 3""")  # fmt: skip
def elastic_net_fold_scores(spark, folder):
    """91 penalties on every walk-forward fold, from one scan."""
    s = sup(spark, folder).select("d", (F.col("volume") / 25).alias("x"), (F.col("close") / 40000).alias("y"))
    found = tuning.elastic_net_folds(s, "d", split(spark, folder), ["x"], "y", PENALTIES)
    return shown(found.select("fold", "candidate", "n_train", "n_val", F.get("coefficients", F.lit(0)).alias("slope"), "intercept", "loss"))


CHARS = ["score", "size", "noise"]
RANKED = f"""{GRID}, ch AS (SELECT d, e, ret, score, CAST(e AS DOUBLE) AS size, CAST((e * 7919) % 101 AS DOUBLE) AS noise FROM grid WHERE ret IS NOT NULL), n AS (SELECT *, count(*) OVER (PARTITION BY d) AS n FROM ch),
rk AS (SELECT d, n, ret, {', '.join(f"CASE WHEN n = 1 THEN 0 ELSE (rank() OVER (PARTITION BY d ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY d, {c}) - 1) / 2.0) / (n - 1) - 0.5 END AS {c}" for c in CHARS)} FROM n)"""


def characteristics(spark, folder):
    return grid(spark, folder).withColumn("size", F.col("e").cast("double")).withColumn("noise", F.pmod(F.col("e") * 7919, F.lit(101)).cast("double"))


@register("ipca_moments", f"""WITH {RANKED} SELECT d, n, {r('sum(score * score)', 'score_score')}, {r('sum(score * size)', 'score_size')}, {r('sum(size * noise)', 'size_noise')}, {r('sum(score)', 'score_constant')},
 {r('sum(score * ret)', 'score_return')}, {r('sum(size * ret)', 'size_return')}, {r('sum(ret)', 'constant_return')} FROM rk GROUP BY d, n""")  # fmt: skip
def ipca_moments(spark, folder):
    """Cross products of ranked characteristics by date: all that the estimation reads of a panel."""
    rows = characteristics(spark, folder).where("ret is not null")
    ranked = sg.cross_sectional_ranks(rows, "d", CHARS).withColumn("constant", F.lit(1.0))
    packed = latent.moments(ranked, "d", "ret", [*CHARS, "constant"])

    @F.arrow_udf("array<double>")
    def opened(m: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x, np.float64) for x in m.to_pylist()], pa.list_(pa.float64()))

    at = {"score_score": 0, "score_size": 1, "size_noise": 6, "score_constant": 3, "score_return": 16, "size_return": 17, "constant_return": 19}
    return shown(packed.select("d", "n", opened("m").alias("m")).select("d", "n", *[F.get("m", F.lit(i)).alias(c) for c, i in at.items()]))


@register("ipca_panel_audit", f"""WITH {GRID}, pw AS (SELECT d, e, CASE WHEN v IS NOT NULL AND e % 2 = 0 THEN exp(ret) - 1 - rf END AS ret, score, v FROM grid WHERE d >= (SELECT min(d) + 5 FROM grid)), dc AS (SELECT d, avg(CAST(score IS NOT NULL AS INT) + CAST(v IS NOT NULL AS INT)) / 2 AS x FROM pw GROUP BY 1)
SELECT count(*) AS grid_rows, count(ret) AS observed_returns, count(*) - count(ret) AS rejected_returns, count(DISTINCT e) AS entities, {r('avg(CAST(score IS NOT NULL AS INT))', 'score_there')}, {r('avg(ret)', 'mean_return')}, {r('(SELECT median(x) FROM dc)', 'median_coverage')} FROM pw""")  # fmt: skip
def ipca_panel_audit(spark, folder):
    """Only returns observed on their date count, here those of even users; log returns become simple ones less the risk-free rate."""
    g = grid(spark, folder).withColumn("seen", F.col("v").isNotNull() & (F.col("e") % 2 == 0))
    first = g.agg(F.min("d")).first()[0]
    rates = g.select("d", "rf").distinct()
    panel = latent.prepare_panel(g.drop("rf"), "d", "e", "ret", "seen", ["score", "v"], first + dt.timedelta(5), dt.date(9999, 1, 1), "log", rates)
    found = latent.panel_audit(panel, "d", "e", "ret", ["score", "v"]).crossJoin(panel.agg(F.avg("ret").alias("mean_return")))  # a row each
    return shown(found.select("grid_rows", "observed_returns", "rejected_returns", "entities", F.col("non_missing.score").alias("score_there"), "mean_return", F.get("daily_coverage", F.lit(2)).alias("median_coverage")))


@register("factor_ipca")
def ipca(spark, folder):
    """One latent factor of user returns by date; tests recover simulated factors."""
    f = latent.estimate(characteristics(spark, folder), "d", "e", "ret", CHARS, 1)
    return shown(f.factors.select("d", F.get("factors", F.lit(0)).alias("factor")))


@register("prediction_aligned_target", f"WITH {USR} SELECT a.d, a.e, {r('b.v', 'v')} FROM usr a LEFT JOIN (SELECT * FROM usr WHERE k >= 2) b ON a.d = b.d AND a.e = b.e")
def aligned_target(spark, folder):
    u = usr(spark, folder).withColumn("observed", F.col("k") >= 2)
    return shown(predictions.aligned_target(u.select("d", "e"), u, ["d", "e"], "v", "observed"))


@register("prediction_evaluated_sample", f"WITH {USR} SELECT d, e, {r('v', 'v')} FROM usr WHERE k >= 2")
def evaluated_sample(spark, folder):
    """Unlike the aligned target, only rows whose label counts."""
    u = usr(spark, folder).withColumn("observed", F.col("k") >= 2)
    return shown(predictions.evaluated_sample(u.select("d", "e"), u, ["d", "e"], "v", "observed"))


@register("prediction_errors", f"WITH {USR} SELECT CAST(count(*) - count(DISTINCT e) AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS not_finite, CAST(0 AS BIGINT) AS bad_probabilities, CAST(0 AS BIGINT) AS bad_quantiles FROM usr")
def prediction_errors(spark, folder):
    return predictions.prediction_errors(usr(spark, folder), ["e"], "regression", "v")


@register("prediction_metrics", f"WITH {USR} SELECT count(*) AS n, {r('avg((v - 10 * k) * (v - 10 * k))', 'mse')}, {r('avg(abs(v - 10 * k))', 'mae')}, {r('1 - sum((v - 10 * k) * (v - 10 * k)) / (var_pop(10 * k) * count(*))', 'r_squared')} FROM usr")
def prediction_metrics(spark, folder):
    return shown(predictions.prediction_metrics(usr(spark, folder).withColumn("t", 10.0 * F.col("k")), "v", "t", "regression"))


@register("prediction_objective_panel", f"WITH {USR} SELECT d, count(*) AS n, count(*) FILTER (k >= 2) AS valid, {r('sum(CASE WHEN k >= 2 THEN v ELSE 0 END)', 'total')} FROM usr GROUP BY d HAVING count(*) FILTER (k >= 2) > 0")
def objective_panel(spark, folder):
    u = usr(spark, folder).withColumn("ret", F.when(F.col("k") >= 2, 0.01))
    p = predictions.objective_panel(u, "d", "v", "ret")
    return shown(p.groupBy("d").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.sum("v").alias("total")))
