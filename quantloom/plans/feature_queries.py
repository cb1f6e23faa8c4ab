"""One query for each feature and modifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import build_features
from ..panel import Panel
from .registry import ORACLE_SQL, QUERIES, SUP, WE, r, register, shown, sup

T = "ROWS BETWEEN {} PRECEDING AND CURRENT ROW"
LR = f"lr AS (SELECT *, ln(close) - lag(ln(close)) OVER {WE} AS lr, lead(ln(close), 2) OVER {WE} - ln(close) AS fwd FROM sup)"


def trailing(n: int) -> str:
    return f"(PARTITION BY e ORDER BY d {T.format(n - 1)})"


def full(column: str, n: int, out: str) -> str:
    return f"CASE WHEN count({column}) OVER {trailing(n)} >= {n} THEN {out} END"


W5 = trailing(5)
MEAN, M2, M3 = (f"avg({x}) OVER {W5}" for x in ("lr", "lr * lr", "lr * lr * lr"))
SPREAD = f"({M2} - ({MEAN}) * ({MEAN}))"
AMIHUD = "CASE WHEN close * volume > 0 THEN abs(lr) / (close * volume) END"

#: name, spec, SQL expression over lr
FEATURES = [
    ("log_change", {"op": "log_change", "column": "close", "horizon": 3}, f"ln(close) - lag(ln(close), 3) OVER {WE}"),
    ("log_change_times", {"op": "log_change", "column": "close", "times": "volume"}, f"ln(close * volume) - lag(ln(close * volume)) OVER {WE}"),
    ("simple_change", {"op": "simple_change", "column": "close", "horizon": 2}, f"close / NULLIF(lag(close, 2) OVER {WE}, 0) - 1"),
    ("positive_indicator", {"op": "positive_indicator", "column": "close"}, f"CAST(close / NULLIF(lag(close) OVER {WE}, 0) - 1 > 0 AS DOUBLE)"),
    ("log_difference", {"op": "log_difference", "left": "high", "right": "low"}, f"ln(high) - lag(ln(low)) OVER {WE}"),
    ("simple_difference", {"op": "simple_difference", "left": "high", "right": "low"}, f"high / NULLIF(lag(low) OVER {WE}, 0) - 1"),
    ("log_ratio", {"op": "log_ratio", "numerator": "high", "denominator": "low"}, "ln(high) - ln(low)"),
    ("simple_ratio", {"op": "simple_ratio", "numerator": "close", "denominator": "low"}, "close / NULLIF(low, 0) - 1"),
    ("ratio", {"op": "ratio", "numerator": "close", "denominator": "volume"}, "close / NULLIF(volume, 0)"),
    ("net_ratio", {"op": "net_ratio", "add": ["close", "high"], "subtract": ["low", "sparse"], "denominator": "volume"}, "(close + high - (low + sparse)) / NULLIF(volume, 0)"),
    ("range_location", {"op": "range_location", "value": "close", "high": "high", "low": "low"}, "(2 * close - high - low) / NULLIF(high - low, 0)"),
    ("relative_spread", {"op": "relative_spread", "upper": "high", "lower": "low"}, "(high - low) / NULLIF((high + low) / 2, 0)"),
    ("rolling_volatility", {"op": "rolling_volatility", "column": "close", "window": 5}, full("lr", 5, f"stddev_samp(lr) OVER {W5}")),
    ("rolling_volatility_few", {"op": "rolling_volatility", "column": "close", "window": 21, "min_periods": 3}, f"CASE WHEN count(lr) OVER {trailing(21)} >= 3 THEN stddev_samp(lr) OVER {trailing(21)} END"),
    ("downside_deviation", {"op": "downside_deviation", "column": "close", "window": 5}, full("lr", 5, f"sqrt(avg(CASE WHEN lr < 0 THEN lr * lr WHEN lr IS NOT NULL THEN 0 END) OVER {W5})")),
    ("rolling_skewness", {"op": "rolling_skewness", "column": "close", "window": 5}, full("lr", 5, f"CASE WHEN {SPREAD} > 1e-14 THEN ({M3} - 3 * ({MEAN}) * ({M2}) + 2 * pow({MEAN}, 3)) / pow({SPREAD}, 1.5) END")),
    ("high_proximity", {"op": "high_proximity", "value": "close", "high": "high", "window": 5}, full("high", 5, f"CASE WHEN max(high) OVER {W5} > 0 THEN close / max(high) OVER {W5} END")),
    ("amihud_illiquidity", {"op": "amihud_illiquidity", "column": "close", "volume": "volume", "window": 5, "log": True}, full(AMIHUD, 5, f"ln(avg({AMIHUD}) OVER {W5})")),
    ("passthrough", {"op": "passthrough", "column": "volume", "as": "x"}, "volume"),
    ("cross_sectional_median", {"op": "cross_sectional_median", "column": "close", "horizon": 2}, "CASE WHEN fwd IS NOT NULL THEN CAST(fwd > median(fwd) OVER (PARTITION BY d) AS DOUBLE) END"),
    ("shift_back", {"op": "log_ratio", "numerator": "high", "denominator": "low", "shift": 2}, f"lag(ln(high) - ln(low), 2) OVER {WE}"),
    ("shift_ahead", {"op": "log_ratio", "numerator": "high", "denominator": "low", "shift": -1}, f"lead(ln(high) - ln(low), 1) OVER {WE}"),
    ("skip_missing", {"op": "log_change", "column": "sparse", "skip_missing": True}, "CASE WHEN sparse IS NOT NULL THEN ln(sparse) - lag(ln(sparse)) OVER (PARTITION BY e, sparse IS NOT NULL ORDER BY d) END"),
]


def _add(name: str, spec: dict, expression: str) -> None:
    def run(spark, folder):
        return shown(build_features(Panel(sup(spark, folder)), [spec | {"as": "x"}]).df)

    QUERIES[f"feature_{name}"] = run
    ORACLE_SQL[f"feature_{name}"] = f"WITH {SUP}, {LR}, f AS (SELECT d, e, {expression} AS x FROM lr) SELECT d, e, {r('x', 'x')} FROM f"


for _name, _spec, _sql in FEATURES:
    _add(_name, _spec, _sql)


@register("panel_flagship", f"""WITH {SUP}, {LR}, f AS (SELECT d, e, close / NULLIF(lag(close) OVER {WE}, 0) - 1 AS change, {full('lr', 21, f'stddev_samp(lr) OVER {trailing(21)}')} AS vol FROM lr)
SELECT d, count(*) AS n, {r('avg(change)', 'mean_change')}, {r('median(change)', 'median_change')}, {r('avg(vol)', 'mean_vol')} FROM f GROUP BY d""")  # fmt: skip
def panel_flagship(spark, folder):
    """Features of the supplier panel, then their cross-section by date."""
    specs = [{"op": "simple_change", "column": "close", "as": "change"}, {"op": "rolling_volatility", "column": "close", "window": 21, "as": "vol"}]
    f = build_features(Panel(sup(spark, folder)), specs).df
    return shown(f.groupBy("d").agg(F.count("*").alias("n"), F.avg("change").alias("mean_change"), F.median("change").alias("median_change"), F.avg("vol").alias("mean_vol")))
