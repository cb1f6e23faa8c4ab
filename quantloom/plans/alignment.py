"""Queries of point-in-time alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align
from ..panel import Panel
from .registry import USR, r, register, shown, table, usr

CLICKS = "g AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'click')"
OTHER = "s AS (SELECT ts, user_id, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)"
SPELL = f"""{USR}, first AS (SELECT e, min(d) AS lo, max(d) AS hi FROM usr GROUP BY e),
p AS (SELECT u.*, CASE WHEN (u.e + day(u.d)) % 9 = 0 THEN NULL WHEN day(u.d) <= 15 THEN lo ELSE CAST(lo + INTERVAL 3 DAY AS DATE) END AS s0, CASE WHEN day(u.d) <= 15 THEN CAST(hi - INTERVAL 2 DAY AS DATE) ELSE hi END AS s1 FROM usr u JOIN first USING (e)),
act AS (SELECT * FROM p WHERE s0 IS NOT NULL AND d BETWEEN s0 AND s1),
ch AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN s0 IS DISTINCT FROM lag(s0) OVER w OR s1 IS DISTINCT FROM lag(s1) OVER w THEN 1 ELSE 0 END AS c FROM act WINDOW w AS (PARTITION BY e ORDER BY d)),
seg AS (SELECT *, CAST(sum(c) OVER (PARTITION BY e ORDER BY d ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM ch)"""


def spelled(spark, folder) -> Panel:
    u = usr(spark, folder)
    ends = u.groupBy("e").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    p = u.join(ends, "e")
    s0 = F.when((F.col("e") + F.day("d")) % 9 == 0, None).when(F.day("d") <= 15, F.col("lo")).otherwise(F.date_add("lo", 3))
    s1 = F.when(F.day("d") <= 15, F.date_sub("hi", 2)).otherwise(F.col("hi"))
    return Panel(p.select("d", "e", "v", "k", s0.alias("s0"), s1.alias("s1")))


def purchases(spark, folder):
    return table(spark, folder, "events").where("event_type = 'purchase'").groupBy("ts", "user_id").agg(F.max("value").alias("value"))


@register("align_asof", f"WITH {CLICKS}, {OTHER} SELECT g.event_id, g.user_id, {r('s.value', 'value')}, s.ts AS source FROM g ASOF LEFT JOIN s ON g.user_id = s.user_id AND g.ts >= s.ts")
def asof(spark, folder):
    clicks = table(spark, folder, "events").where("event_type = 'click'").select("event_id", "ts", "user_id")
    out = align.asof(clicks, purchases(spark, folder), "ts", ["user_id"])
    return shown(out.select("event_id", "user_id", "value", F.col("value__source").alias("source")))


@register("align_active_grid", f"WITH {SPELL} SELECT d, e, {r('v', 'v')}, k FROM act")
def active_grid(spark, folder):
    return shown(align.active_grid(spelled(spark, folder), [("s0", "s1")]).df.select("d", "e", "v", "k"))


@register("align_segments", f"WITH {SPELL} SELECT d, e, segment, min(d) OVER (PARTITION BY e, segment) AS segment_start FROM seg")
def segments(spark, folder):
    p = align.segments(align.active_grid(spelled(spark, folder), [("s0", "s1")]), [("s0", "s1")])
    return shown(p.df.select("d", "e", "segment", "segment_start"))


@register("align_and_mask", f"""WITH {SPELL}, f AS (SELECT CAST(ts AS DATE) AS d, user_id AS e, max(value) AS x FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
st AS (SELECT *, min(d) OVER (PARTITION BY e, segment) AS start FROM seg),
j AS (SELECT st.d, st.e, st.segment, CASE WHEN f.d >= start THEN f.x END AS x, CASE WHEN f.d >= start THEN f.d END AS src FROM st ASOF LEFT JOIN f ON st.e = f.e AND st.d >= f.d),
o AS (SELECT *, src IS NOT NULL AND src IS DISTINCT FROM lag(src) OVER (PARTITION BY e, segment ORDER BY d) AS observed, row_number() OVER (PARTITION BY e, segment ORDER BY d) AS n FROM j)
SELECT d, e, segment, {r('x', 'x')}, observed, coalesce(n - max(CASE WHEN observed THEN n END) OVER (PARTITION BY e, segment ORDER BY d ROWS UNBOUNDED PRECEDING), -1) AS age FROM o""")  # fmt: skip
def align_and_mask(spark, folder):
    source = table(spark, folder, "events").where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("d"), F.col("user_id").alias("e")).agg(F.max("value").alias("x"))
    p = align.align_and_mask(spelled(spark, folder), [Panel(source)], [("s0", "s1")])
    return shown(p.df.select("d", "e", "segment", "x", F.col("x__observed").alias("observed"), F.col("x__age").alias("age")))


@register("align_context", f"""WITH {USR}, o AS (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS x FROM orders GROUP BY 1), g AS (SELECT DISTINCT d FROM usr),
a AS (SELECT g.d, o.x, o.d AS src FROM g ASOF LEFT JOIN o ON g.d >= o.d) SELECT usr.d, e, {r('x', 'x')}, src FROM usr JOIN a USING (d)""")  # fmt: skip
def context(spark, folder):
    o = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("x"))
    u = usr(spark, folder).select("d", "e")
    dates = align.asof(u.select("d").distinct(), o, "d")
    return shown(u.join(dates, "d").select("d", "e", "x", F.col("x__source").alias("src")))


@register("align_common_items", f"WITH {USR} SELECT d, e FROM usr WHERE k >= 2 INTERSECT SELECT d, e FROM usr WHERE v > 200")
def common_items(spark, folder):
    u = usr(spark, folder)
    return align.common_items([u.where("k >= 2"), u.where("v > 200")], ["d", "e"])


@register("align_left_reindex", f"WITH {USR} SELECT a.d, a.e, b.k FROM usr a LEFT JOIN (SELECT * FROM usr WHERE k >= 3) b ON a.d = b.d AND a.e = b.e")
def left_reindex(spark, folder):
    u = usr(spark, folder)
    return align.left_reindex(u.select("d", "e"), u.where("k >= 3").select("d", "e", "k"), ["d", "e"])


@register("align_dense_grid", f"WITH {USR} SELECT a.d, b.e, {r('u.v', 'v')} FROM (SELECT DISTINCT d FROM usr) a CROSS JOIN (SELECT DISTINCT e FROM usr) b LEFT JOIN usr u ON u.d = a.d AND u.e = b.e")
def dense(spark, folder):
    return shown(align.dense_grid(usr(spark, folder).select("d", "e", "v"), "d", "e"))
