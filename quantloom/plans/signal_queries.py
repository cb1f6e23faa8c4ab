"""Queries of signal evaluation, corrections and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare
from ..operators import signals as sg
from .registry import GRID, grid, r, register, shown, usr

NEXT = f"{GRID}, x AS (SELECT *, lead(ret) OVER (PARTITION BY e ORDER BY d) AS target FROM grid)"


def ranked(c: str, by: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {by}, {c} IS NOT NULL ORDER BY {c}) + (count({c}) OVER (PARTITION BY {by}, {c}) - 1) / 2.0 END"


PAIR = f"""{NEXT}, p AS (SELECT *, CASE WHEN score IS NOT NULL AND target IS NOT NULL THEN score END AS s, CASE WHEN score IS NOT NULL AND target IS NOT NULL THEN target END AS t FROM x),
q AS (SELECT *, {ranked('s', 'd')} AS rs, {ranked('t', 'd')} AS rt, CASE WHEN s IS NOT NULL AND abs(score) > 1e-12 THEN CAST((score > 0) = (target > 0) AS DOUBLE) END AS hit FROM p),
per AS (SELECT d, count(s) AS observations, CASE WHEN stddev_pop(s) * stddev_pop(t) > 1e-24 THEN covar_pop(s, t) / (stddev_pop(s) * stddev_pop(t)) END AS ic, CASE WHEN stddev_pop(rs) * stddev_pop(rt) > 1e-24 THEN covar_pop(rs, rt) / (stddev_pop(rs) * stddev_pop(rt)) END AS rank_ic,
 count(hit) AS directional_observations, avg(hit) AS hit_rate, CASE WHEN abs(sum(CASE WHEN hit IS NOT NULL THEN abs(target) END)) > 1e-12 THEN sum(hit * abs(target)) / sum(CASE WHEN hit IS NOT NULL THEN abs(target) END) END AS weighted_hit_rate FROM q GROUP BY d)"""
BUCKET = f"{NEXT}, n AS (SELECT *, row_number() OVER (PARTITION BY d, score IS NOT NULL ORDER BY score, e) AS k, count(score) OVER (PARTITION BY d) AS m FROM x), b AS (SELECT *, CASE WHEN score IS NOT NULL AND m > 1 THEN CAST(CASE WHEN m >= 5 THEN floor((k - 1) * 5 / m::DOUBLE + 1e-12) ELSE floor((k - 1) * 4 / (m - 1)::DOUBLE + 1e-12) END + 1 AS BIGINT) END AS bucket FROM n)"


def panel(spark, folder):
    g = grid(spark, folder)
    return g.withColumn("target", sg.shift_target(g, "d", "e", "ret", 1))


def per_date(spark, folder):
    return sg.date_diagnostics(panel(spark, folder), "d", "score", "target")


@register("signal_date_diagnostics", f"WITH {PAIR} SELECT d, observations, directional_observations, {r('ic', 'ic')}, {r('rank_ic', 'rank_ic')}, {r('hit_rate', 'hit_rate')}, {r('weighted_hit_rate', 'weighted_hit_rate')} FROM per")
def date_diagnostics(spark, folder):
    return shown(per_date(spark, folder).select("d", "observations", "directional_observations", "ic", "rank_ic", "hit_rate", "weighted_hit_rate"))


@register("signal_ic_summary", f"WITH {PAIR} SELECT count(rank_ic) AS dates, {r('avg(rank_ic)', 'mean')}, {r('median(rank_ic)', 'median')}, {r('stddev_samp(rank_ic)', 'std')}, {r('avg(CAST(rank_ic > 0 AS DOUBLE))', 'positive_rate')}, {r('avg(rank_ic) / stddev_samp(rank_ic)', 'information_ratio')}, {r('avg(rank_ic) / stddev_samp(rank_ic) * sqrt(252)', 'annualized_information_ratio')} FROM per")
def ic_summary(spark, folder):
    return shown(sg.ic_summary(per_date(spark, folder)))


@register("signal_rolling", f"WITH {PAIR} SELECT d, {r('CASE WHEN count(ic) OVER w = 5 THEN avg(ic) OVER w END', 'ic_mean')}, {r('CASE WHEN count(ic) OVER w = 5 THEN stddev_samp(ic) OVER w END', 'ic_std')}, {r('CASE WHEN count(ic) OVER w = 5 THEN avg(ic) OVER w / NULLIF(stddev_samp(ic) OVER w, 0) END', 'ic_ir')} FROM per WINDOW w AS (ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling(spark, folder):
    return shown(sg.rolling_diagnostics(per_date(spark, folder), "d", 5, ["ic"]))


@register("signal_decay", f"WITH {GRID}, " + ", ".join(f"l{k} AS (SELECT d, score AS s, lead(ret, {k}) OVER (PARTITION BY e ORDER BY d) AS t FROM grid), m{k} AS (SELECT * FROM l{k} WHERE s IS NOT NULL AND t IS NOT NULL), i{k} AS (SELECT CASE WHEN stddev_pop(s) * stddev_pop(t) > 1e-24 THEN covar_pop(s, t) / (stddev_pop(s) * stddev_pop(t)) END AS ic FROM m{k} GROUP BY d)" for k in (1, 2)) + " " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS lead, (SELECT count(*) FROM m{k}) AS pairs, {r(f'(SELECT avg(ic) FROM i{k})', 'mean_ic')}, {r(f'(SELECT corr(s, t) FROM m{k})', 'pooled')}" for k in (1, 2)))
def decay(spark, folder):
    return shown(sg.signal_decay(grid(spark, folder), "d", "e", "score", "ret", [1, 2]).select("lead", "pairs", "mean_ic", "pooled"))


@register("signal_rank_buckets", f"WITH {BUCKET} SELECT d, e, bucket FROM b")
def rank_buckets(spark, folder):
    return sg.rank_buckets(panel(spark, folder), "score", 5, ["e"], ["d"]).select("d", "e", "bucket")


@register("signal_bucket_summary", f"WITH {BUCKET} SELECT bucket, count(*) AS size, count(target) AS outcomes, {r('avg(target)', 'mean')}, {r('median(target)', 'median')}, {r('min(target)', 'minimum')}, {r('max(target)', 'maximum')}, {r('avg(CASE WHEN target IS NOT NULL AND abs(score) > 1e-12 THEN CAST((score > 0) = (target > 0) AS DOUBLE) END)', 'hit_rate')} FROM b WHERE bucket IS NOT NULL GROUP BY bucket")
def bucket_summary(spark, folder):
    return shown(sg.signal_buckets(sg.rank_buckets(panel(spark, folder), "score", 5, ["e"], ["d"]), "score", "target"))


@register("signal_bucket_attribution", f"WITH {BUCKET} SELECT bucket, {r('min(score)', 'score_minimum')}, {r('max(score)', 'score_maximum')}, count(*) AS size, {r('avg(target)', 'mean_return')}, {r('sum(score * coalesce(target, 0))', 'total_contribution')}, {r('sum(score * coalesce(target, 0)) / (SELECT count(DISTINCT d) FROM b)', 'mean_daily_contribution')} FROM b WHERE bucket IS NOT NULL GROUP BY bucket")
def bucket_attribution(spark, folder):
    return shown(sg.attribute_buckets(sg.rank_buckets(panel(spark, folder), "score", 5, ["e"], ["d"]), "d", "score", "target", "score"))


@register("signal_confusion", f"WITH {NEXT} SELECT target > 0 AS actual_up, score > 0 AS predicted_up, count(*) AS n FROM x WHERE abs(score) > 1e-12 AND target IS NOT NULL GROUP BY 1, 2")
def confusion(spark, folder):
    return sg.confusion(panel(spark, folder), "score", "target")


@register("signal_auc", f"WITH {NEXT}, y AS (SELECT target > 0 AS up, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM x WHERE score IS NOT NULL AND target IS NOT NULL) SELECT {r('(sum(k) FILTER (up) - count(*) FILTER (up) * (count(*) FILTER (up) + 1) / 2.0) / (count(*) FILTER (up) * count(*) FILTER (NOT up))', 'roc_auc')} FROM y")
def auc(spark, folder):
    return shown(sg.auc(panel(spark, folder), "score", "target"))


@register("signal_roc", f"WITH {NEXT}, y AS (SELECT score, count(*) FILTER (target > 0) AS p, count(*) FILTER (target <= 0) AS n FROM x WHERE score IS NOT NULL AND target IS NOT NULL GROUP BY score) SELECT {r('score', 'score')}, {r('sum(n) OVER w / sum(n) OVER ()', 'fpr')}, {r('sum(p) OVER w / sum(p) OVER ()', 'tpr')} FROM y WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)")
def roc(spark, folder):
    return shown(sg.roc_points(panel(spark, folder), "score", "target"))


@register("factor_cross_sectional_ranks", f"WITH {GRID}, k AS (SELECT d, e, {ranked('v', 'd')} AS k, count(v) OVER (PARTITION BY d) AS n FROM grid) SELECT d, e, {r('CASE WHEN k IS NOT NULL THEN CASE WHEN n = 1 THEN 0 ELSE (k - 1) / greatest(n - 1, 1) - 0.5 END END', 'v')} FROM k")
def cross_sectional_ranks(spark, folder):
    return shown(sg.cross_sectional_ranks(grid(spark, folder).select("d", "e", "v"), "d", ["v"]))


@register("factor_eligibility", f"WITH {GRID} SELECT count(*) AS input, count(*) FILTER (ret IS NULL) AS missing_return, CAST(0 AS BIGINT) AS no_characteristic, CAST(0 AS BIGINT) AS low_coverage, count(*) FILTER (ret IS NOT NULL) AS kept FROM grid")
def eligibility(spark, folder):
    return sg.ipca_eligibility(grid(spark, folder), "ret", ["v", "score"], 0.5)


P_VALUES = f"{GRID}, p AS (SELECT e, CASE WHEN e % 11 <> 0 THEN avg(v) / 200 END AS p_value FROM grid WHERE v IS NOT NULL GROUP BY e HAVING avg(v) < 200), n AS (SELECT *, count(p_value) OVER () AS n, row_number() OVER (PARTITION BY p_value IS NOT NULL ORDER BY p_value, e) AS k FROM p)"


def p_values(spark, folder):
    # a dense grid has values for these rows alone
    p = usr(spark, folder).where("v is not null and d is not null and e is not null").groupBy("e").agg(F.avg("v").alias("m")).where("m < 200")
    return p.select("e", F.when(F.col("e") % 11 != 0, F.col("m") / 200).alias("p_value"))


@register("inference_holm", f"WITH {P_VALUES} SELECT e, {r('CASE WHEN p_value IS NOT NULL THEN least(max(p_value * (n - k + 1)) OVER (PARTITION BY p_value IS NOT NULL ORDER BY k ROWS UNBOUNDED PRECEDING), 1) END', 'adjusted')}, CASE WHEN p_value IS NULL THEN '' WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**' WHEN p_value < 0.1 THEN '*' ELSE '(ns)' END AS stars FROM n")
def holm(spark, folder):
    return shown(sg.adjust(p_values(spark, folder), how="holm", order=["e"]).select("e", "adjusted", sg.stars(F.col("p_value")).alias("stars")))


@register("inference_benjamini_hochberg", f"WITH {P_VALUES} SELECT e, {r('CASE WHEN p_value IS NOT NULL THEN least(min(p_value * n / k) OVER (PARTITION BY p_value IS NOT NULL ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) END', 'adjusted')} FROM n")
def benjamini_hochberg(spark, folder):
    return shown(sg.adjust(p_values(spark, folder), how="bh", order=["e"]).select("e", "adjusted"))


MODELS = f"{GRID}, m AS (SELECT d, e, CAST(e % 3 AS VARCHAR) AS model, v / 100 AS weight FROM grid WHERE v IS NOT NULL UNION ALL SELECT d, e, 'all', 1 - v / 500 FROM grid WHERE v IS NOT NULL)"


def models(spark, folder):
    g = grid(spark, folder).where("v is not null")
    return g.select("d", "e", (F.col("e") % 3).cast("string").alias("model"), (F.col("v") / 100).alias("weight")).unionByName(g.select("d", "e", F.lit("all").alias("model"), (1 - F.col("v") / 500).alias("weight")))


@register("compare_return_correlation", f"WITH {MODELS}, y AS (SELECT model, d, sum(weight) AS x FROM m GROUP BY 1, 2) SELECT a.model AS a, b.model AS b, count(*) AS dates, {r('corr(a.x, b.x)', 'correlation')} FROM y a JOIN y b ON a.d = b.d AND a.model < b.model GROUP BY 1, 2")
def return_correlation(spark, folder):
    y = models(spark, folder).groupBy("model", "d").agg(F.sum("weight").alias("x"))
    return shown(sg.return_correlation(y, "model", "d", "x"))


@register("compare_position_overlap", f"""WITH {MODELS}, n AS (SELECT model, d, sqrt(sum(weight * weight)) AS n FROM m GROUP BY 1, 2), t AS (SELECT a.model AS a, b.model AS b, a.d, sum(a.weight * b.weight) AS dot FROM m a JOIN m b ON a.d = b.d AND a.e = b.e AND a.model < b.model GROUP BY 1, 2, 3)
SELECT p.model AS a, q.model AS b, {r('avg(coalesce(dot, 0) / (p.n * q.n))', 'overlap')} FROM n p JOIN n q ON p.d = q.d AND p.model < q.model LEFT JOIN t ON t.a = p.model AND t.b = q.model AND t.d = p.d GROUP BY 1, 2""")  # fmt: skip
def position_overlap(spark, folder):
    return shown(sg.position_overlap(models(spark, folder), "model", "d", "e"))


@register("compare_signal_correlation", f"WITH {MODELS}, j AS (SELECT a.model AS a, b.model AS b, a.weight AS x, b.weight AS y FROM m a JOIN m b ON a.d = b.d AND a.e = b.e AND a.model < b.model), k AS (SELECT a, b, {ranked('x', 'a, b')} AS rx, {ranked('y', 'a, b')} AS ry FROM j) SELECT a, b, count(*) AS items, {r('corr(rx, ry)', 'correlation')} FROM k GROUP BY 1, 2")
def signal_correlation(spark, folder):
    return shown(compare.signal_correlation(models(spark, folder), "model", "d", "e", "weight"))


@register("signal_headline", f"""WITH {BUCKET}, h AS (SELECT d, avg(CASE WHEN score IS NOT NULL AND target IS NOT NULL AND abs(score) > 1e-12 THEN CAST((score > 0) = (target > 0) AS DOUBLE) END) AS hit FROM b GROUP BY d)
SELECT {r('avg(score)', 'score_mean')}, {r('stddev_samp(score)', 'score_std')}, {r('corr(score, target)', 'pooled')}, {r('avg(CAST(score IS NOT NULL AS DOUBLE))', 'coverage')}, {r('(SELECT avg(hit) FROM h)', 'directional_accuracy')}, {r('avg(target) FILTER (bucket = 5) - avg(target) FILTER (bucket = 1)', 'top_minus_bottom')} FROM b""")  # fmt: skip
def headline(spark, folder):
    return shown(sg.headline(panel(spark, folder), "d", "score", "target", order=["e"]))
