"""Queries of the cleaning steps and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..panel import Panel
from ..sources import fingerprint
from .registry import SUP, r, register, shown, sup, table

VALUES = ("close", "high", "low", "volume", "sparse")
ALL = ", ".join(r(c, c) for c in VALUES)
RULES = [
    clean.Rule("span", (clean.Constraint(("high",), "le", 50000.0), clean.Constraint(("close",), "ge", "low")), "left"),
    clean.Rule("thin", (clean.Constraint(("volume",), "gt", 5.0),), ("volume", "sparse")),
    clean.Rule("pair", (clean.Constraint(("sparse",), "le", "volume"),), "operands"),
]
STEP1 = f"WITH {SUP}, a AS (SELECT d, e, CASE WHEN coalesce(close >= low, true) THEN close END AS close, CASE WHEN coalesce(high <= 50000, true) THEN high END AS high, low, volume, sparse, NOT (coalesce(high <= 50000, true) AND coalesce(close >= low, true)) AS v1, CAST(high > 50000 AS INT) + CAST(close < low AS INT) AS c1 FROM sup)"
STEP2 = "b AS (SELECT d, e, close, high, low, CASE WHEN coalesce(volume > 5, true) THEN volume END AS volume, CASE WHEN coalesce(volume > 5, true) THEN sparse END AS sparse, v1, c1, NOT coalesce(volume > 5, true) AS v2, CASE WHEN coalesce(volume > 5, true) THEN 0 ELSE 1 + CAST(sparse IS NOT NULL AS INT) END AS c2 FROM a)"
STEP3 = "c AS (SELECT d, e, close, high, low, CASE WHEN coalesce(sparse <= volume, true) THEN volume END AS volume, CASE WHEN coalesce(sparse <= volume, true) THEN sparse END AS sparse, v1, c1, v2, c2, NOT coalesce(sparse <= volume, true) AS v3, CASE WHEN coalesce(sparse <= volume, true) THEN 0 ELSE 2 END AS c3 FROM b)"


@register("clean_deduplicate", f"SELECT CAST(l_shipdate AS DATE) AS d, l_suppkey AS e, {r('avg(l_quantity)', 'q')}, {r('avg(l_discount)', 'x')} FROM lineitem GROUP BY 1, 2")
def deduplicate(spark, folder):
    raw = table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("d"), F.col("l_suppkey").alias("e"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("x"))
    return shown(clean.deduplicate(Panel(raw)).df)


@register("clean_corporate_adjustment", f"WITH {SUP} SELECT d, e, {r('close / NULLIF(sparse, 0)', 'close')}, {r('high / NULLIF(sparse, 0)', 'high')}, {r('volume / NULLIF(low, 0)', 'volume')} FROM sup")
def corporate_adjustment(spark, folder):
    p = clean.corporate_adjustment(Panel(sup(spark, folder)), ["close", "high"], "sparse", volume="volume", share_factor="low")
    return shown(p.df.select("d", "e", "close", "high", "volume"))


@register("clean_consistency_check", f"{STEP1}, {STEP2}, {STEP3} SELECT d, e, {ALL} FROM c")
def consistency_check(spark, folder):
    return shown(clean.consistency_check(Panel(sup(spark, folder)), RULES).df)


@register("clean_consistency_report", f"""{STEP1}, {STEP2}, {STEP3}
SELECT 'span' AS rule, count(*) FILTER (v1) AS violating_rows, CAST(coalesce(sum(c1), 0) AS BIGINT) AS invalidated_cells FROM c
UNION ALL SELECT 'thin', count(*) FILTER (v2), CAST(coalesce(sum(c2), 0) AS BIGINT) FROM c UNION ALL SELECT 'pair', count(*) FILTER (v3), CAST(coalesce(sum(c3), 0) AS BIGINT) FROM c""")  # fmt: skip
def consistency_report(spark, folder):
    return clean.consistency_report(Panel(sup(spark, folder)), RULES)


@register("clean_non_negative", f"WITH {SUP}, a AS (SELECT d, e, close - 40000 AS x FROM sup) SELECT d, e, {r('CASE WHEN x >= 0 THEN x END', 'x')} FROM a")
def non_negative(spark, folder):
    p = Panel(sup(spark, folder).select("d", "e", (F.col("close") - 40000).alias("x")))
    return shown(clean.non_negative_check(p, ["x"]).df)


@register("clean_impute", f"""WITH {SUP}, a AS (SELECT d, e, volume, last_value(sparse IGNORE NULLS) OVER (PARTITION BY e ORDER BY d ROWS UNBOUNDED PRECEDING) AS filled, coalesce(sparse, 0) AS zero FROM sup)
SELECT d, e, {r('filled', 'filled')}, {r('zero', 'zero')} FROM a WHERE filled IS NOT NULL""")  # fmt: skip
def impute(spark, folder):
    p = Panel(sup(spark, folder).select("d", "e", F.col("sparse").alias("filled"), F.col("sparse").alias("zero")))
    return shown(clean.impute(p, ["filled"], ["zero"]).df)


@register("clean_missing_threshold", f"WITH {SUP}, a AS (SELECT e, avg(CASE WHEN sparse IS NULL THEN 1.0 ELSE 0.0 END) AS m FROM sup GROUP BY e) SELECT d, e, {r('close', 'close')} FROM sup WHERE e IN (SELECT e FROM a WHERE m <= 0.31)")
def missing_threshold(spark, folder):
    p = clean.missing_threshold_filter(Panel(sup(spark, folder)), 0.31, columns=["close", "sparse"])
    return shown(p.df.select("d", "e", "close"))


@register("clean_calendar_filter", f"WITH {SUP} SELECT d, e, {r('close', 'close')} FROM sup WHERE d IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT')")
def calendar_filter(spark, folder):
    sessions = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderdate").alias("session"))
    return shown(clean.calendar_filter(Panel(sup(spark, folder).select("d", "e", "close")), sessions).df)


@register("clean_step_chain", f"WITH {SUP}, a AS (SELECT d, e, CASE WHEN volume >= 0 THEN volume END AS volume, last_value(sparse IGNORE NULLS) OVER (PARTITION BY e ORDER BY d ROWS UNBOUNDED PRECEDING) AS sparse FROM sup) SELECT d, e, {r('volume', 'volume')}, {r('sparse', 'sparse')} FROM a WHERE sparse IS NOT NULL")
def step_chain(spark, folder):
    raw = table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("d"), F.col("l_suppkey").alias("e"), F.col("l_quantity").alias("volume"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("sparse"))
    return shown(clean.apply_steps(Panel(raw), [("deduplicate", {}), ("non_negative_check", {"columns": ["volume"]}), ("impute", {"ffill": ["sparse"]})]).df)


@register("entity_and_date_slice", f"WITH {SUP} SELECT d, e, {r('close', 'close')} FROM sup WHERE e = 7 AND d BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'")
def slices(spark, folder):
    return shown(Panel(sup(spark, folder).select("d", "e", "close")).only(7).between("1995-01-01", "1997-12-31").df)


@register("source_fingerprint")
def source_fingerprint(spark, folder):
    return fingerprint(table(spark, folder, "lineitem"))
