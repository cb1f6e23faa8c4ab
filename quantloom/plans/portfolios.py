"""Queries of portfolio construction, accounting, paths and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare
from ..operators import portfolio as pf
from .registry import GRID, grid, r, register, shown

WEIGHTS = f"{GRID}, w AS (SELECT *, coalesce(CASE WHEN sum(abs(score)) OVER (PARTITION BY d) > 1e-12 THEN score / sum(abs(score)) OVER (PARTITION BY d) END, 0) AS weight, coalesce(ret, 0) AS x FROM grid)"
DAILY = f"""{WEIGHTS}, g AS (SELECT *, greatest(1 + sum(weight * x) OVER (PARTITION BY d) + (1 - sum(weight) OVER (PARTITION BY d)) * rf, 1e-12) AS growth FROM w),
t AS (SELECT *, coalesce(lag(weight * (1 + x) / growth) OVER (PARTITION BY e ORDER BY d), 0) AS drift, coalesce(abs(weight) / NULLIF(sum(abs(weight)) OVER (PARTITION BY d), 0), 0) AS share, row_number() OVER (PARTITION BY d ORDER BY abs(weight) DESC, e) AS o FROM g),
a AS (SELECT d, sum(weight * x) AS risky, sum(weight) AS net_exposure, sum(abs(weight)) AS gross_exposure, sum(greatest(weight, 0)) AS long_exposure, sum(greatest(-weight, 0)) AS short_exposure, max(rf) AS rf,
 sum(greatest(weight, 0) * x) AS long_contribution, sum(least(weight, 0) * x) AS short_contribution, sum(abs(weight - drift)) AS l1_turnover, sum(abs(greatest(weight, 0) - greatest(drift, 0))) AS long_turnover,
 sum(abs(least(weight, 0) - least(drift, 0))) AS short_turnover, sum(share * share) AS concentration_hhi, max(abs(weight)) AS largest_weight, count(*) FILTER (abs(weight) > 1e-12) AS active_positions,
 count(*) FILTER (weight > 1e-12) AS long_positions, count(*) FILTER (weight < -1e-12) AS short_positions, sum(CASE WHEN o <= 5 THEN share ELSE 0 END) AS top5_share, sum(CASE WHEN o <= 10 THEN share ELSE 0 END) AS top10_share FROM t GROUP BY d),
daily AS (SELECT *, 1 - net_exposure AS cash_weight, (1 - net_exposure) * rf AS cash_contribution, l1_turnover / 2 AS one_way_turnover, risky + (1 - net_exposure) * rf AS gross_return, l1_turnover * 0.0015 AS transaction_cost, short_exposure * 0.0002 AS borrow_cost,
 l1_turnover * 0.0015 + short_exposure * 0.0002 AS total_cost, risky + (1 - net_exposure) * rf - l1_turnover * 0.0015 - short_exposure * 0.0002 AS net_return FROM a)"""
PATH = f"""{DAILY}, wl AS (SELECT d, rf, net_return AS r, product(1 + net_return) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS wealth, row_number() OVER (ORDER BY d) AS n FROM daily),
hw AS (SELECT *, greatest(max(wealth) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 1.0) AS high_water FROM wl), dd AS (SELECT *, wealth / high_water - 1 AS drawdown FROM hw),
path AS (SELECT *, n - coalesce(max(CASE WHEN drawdown >= 0 THEN n END) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 0) AS underwater FROM dd)"""
COLUMNS = "risky net_exposure gross_exposure long_exposure short_exposure long_contribution short_contribution l1_turnover long_turnover short_turnover concentration_hhi largest_weight top5_share top10_share cash_weight cash_contribution one_way_turnover gross_return transaction_cost borrow_cost total_cost net_return".split()


def weighted(spark, folder):
    return pf.weights(grid(spark, folder), "d", how="gross")


def daily(spark, folder):
    return pf.account(weighted(spark, folder), "d", "e", fee=0.001, spread=0.0003, slippage=0.0002, borrow=0.0002)


for _how, _sql in (
    ("bounded", "score * least(1.0, 2.0 / greatest(coalesce(sum(abs(score)) OVER (PARTITION BY d), 0), 1e-12))"),
    ("gross", "CASE WHEN sum(abs(score)) OVER (PARTITION BY d) > 1e-12 THEN score * 2.0 / sum(abs(score)) OVER (PARTITION BY d) ELSE 0 END"),
    ("market_neutral", "CASE WHEN sum(abs(c)) OVER (PARTITION BY d) > 1e-12 THEN c * 2.0 / sum(abs(c)) OVER (PARTITION BY d) ELSE 0 END"),
):
    register(f"weights_{_how}", f"WITH {GRID}, n AS (SELECT *, score - avg(score) OVER (PARTITION BY d) AS c FROM grid), x AS (SELECT d, e, coalesce({_sql}, 0) AS weight FROM n) SELECT d, e, {r('weight', 'weight')} FROM x")(
        lambda spark, folder, how=_how: shown(pf.weights(grid(spark, folder), "d", how=how, leverage=2.0).select("d", "e", "weight"))
    )


@register("portfolio_daily", f"WITH {DAILY} SELECT d, active_positions, long_positions, short_positions, {', '.join(r(c, c) for c in COLUMNS)} FROM daily")
def portfolio_daily(spark, folder):
    return shown(daily(spark, folder).select("d", "active_positions", "long_positions", "short_positions", *COLUMNS))


@register("portfolio_paths", f"WITH {PATH} SELECT d, {r('wealth', 'wealth')}, {r('high_water', 'high_water')}, {r('drawdown', 'drawdown')}, underwater FROM path")
def portfolio_paths(spark, folder):
    return shown(pf.paths(daily(spark, folder), "d").select("d", "wealth", "high_water", "drawdown", "underwater"))


@register("portfolio_period_returns", f"WITH {DAILY} SELECT CAST(date_trunc('month', d) AS DATE) AS period, {r('product(1 + net_return) - 1', 'period_return')} FROM daily GROUP BY 1")
def period_returns(spark, folder):
    return shown(pf.period_returns(daily(spark, folder), "d", "month"))


@register("portfolio_rolling_compound", f"WITH {DAILY} SELECT d, {r('CASE WHEN count(*) OVER w = 5 THEN product(1 + net_return) OVER w - 1 END', 'rolling_5')} FROM daily WINDOW w AS (ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_compound(spark, folder):
    return shown(pf.rolling_compound(daily(spark, folder), "d", 5).select("d", "rolling_5"))


METRICS = {
    "total_return": "product(1 + r) - 1", "cagr": "pow(product(1 + r), 252.0 / count(r)) - 1", "annualized_arithmetic_return": "avg(r) * 252", "annualized_volatility": "stddev_samp(r) * sqrt(252)",
    "downside_deviation": "sqrt(avg(pow(least(r, 0), 2))) * sqrt(252)", "sharpe_ratio": "avg(r - rf) / stddev_samp(r - rf) * sqrt(252)", "sortino_ratio": "avg(r) / sqrt(avg(pow(least(r, 0), 2))) * sqrt(252)",
    "omega_ratio": "sum(greatest(r, 0)) / sum(greatest(-r, 0))", "maximum_drawdown": "min(drawdown)", "average_underwater_drawdown": "coalesce(avg(drawdown) FILTER (drawdown < 0), 0)",
    "time_under_water": "avg(CAST(drawdown < 0 AS DOUBLE))", "ulcer_index": "sqrt(avg(drawdown * drawdown))", "skewness": "skewness(r)",
    "positive_period_rate": "avg(CAST(r > 0 AS DOUBLE))", "average_win": "avg(r) FILTER (r > 0)", "average_loss": "avg(r) FILTER (r < 0)", "payoff_ratio": "avg(r) FILTER (r > 0) / abs(avg(r) FILTER (r < 0))",
    "profit_factor": "sum(r) FILTER (r > 0) / -(sum(r) FILTER (r < 0))", "expected_return_per_period": "avg(r)", "largest_win": "max(r)", "largest_loss": "min(r)",
    "tail_ratio": "quantile_cont(r, 0.95) / abs(quantile_cont(r, 0.05))", "worst_rolling_5": "min(r5)", "var_95": "max(v95)", "expected_shortfall_95": "avg(-r) FILTER (-r >= v95)",
    "calmar_ratio": "(pow(product(1 + r), 252.0 / count(r)) - 1) / abs(min(drawdown))",
}


@register("portfolio_performance", f"""WITH {PATH}, m AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN product(1 + r) OVER w - 1 END AS r5, (SELECT quantile_cont(-r, 0.95) FROM path) AS v95 FROM path WINDOW w AS (ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT count(r) AS observations, CAST(max(underwater) AS BIGINT) AS maximum_drawdown_duration, {', '.join(r(x, n) for n, x in METRICS.items())} FROM m""")  # fmt: skip
def performance(spark, folder):
    return shown(pf.performance(daily(spark, folder), "d", levels=(0.95,), rolling=5).select("observations", "maximum_drawdown_duration", *METRICS))


RUN = "SELECT {k} AS k, count(*) AS length FROM (SELECT *, sum(CASE WHEN f AND NOT coalesce(pf, false) THEN 1 ELSE 0 END) OVER ({by} ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(f) OVER ({by} ORDER BY d) AS pf FROM ({src}))) WHERE f GROUP BY {k}, run"


@register("portfolio_streaks", f"""WITH {PATH}, s1 AS ({RUN.format(k="CAST(0 AS INT)", by="", src="SELECT d, r > 0 AS f FROM path")}), s2 AS ({RUN.format(k="CAST(0 AS INT)", by="", src="SELECT d, r < 0 AS f FROM path")}), s3 AS ({RUN.format(k="CAST(0 AS INT)", by="", src="SELECT d, drawdown < 0 AS f FROM path")})
SELECT (SELECT coalesce(max(length), 0) FROM s1) AS maximum_consecutive_wins, (SELECT coalesce(max(length), 0) FROM s2) AS maximum_consecutive_losses, {r('(SELECT coalesce(avg(length), 0) FROM s3)', 'average_drawdown_duration')}, (SELECT coalesce(max(length), 0) FROM s3) AS longest_drawdown""")  # fmt: skip
def streaks(spark, folder):
    return shown(pf.streaks(daily(spark, folder), "d"))


@register("portfolio_holding_period", f"WITH {WEIGHTS}, a AS ({RUN.format(k='e', by='PARTITION BY e', src='SELECT d, e, abs(weight) > 1e-12 AS f FROM w')}) SELECT {r('avg(length)', 'average_position_holding_period')} FROM a")
def holding_period(spark, folder):
    return shown(pf.holding_period(weighted(spark, folder), "d", "e"))


@register("portfolio_trading_summary", f"""WITH {DAILY} SELECT {r('sum(total_cost)', 'total_total_cost')}, {r('sum(l1_turnover)', 'total_l1_turnover')}, {r('avg(gross_exposure)', 'mean_gross_exposure')}, {r('avg(active_positions)', 'mean_active_positions')},
 {r('avg(total_cost) * 252', 'annualized_cost_drag')}, {r('max(largest_weight)', 'maximum_absolute_weight')}, {r('product(1 + gross_return) - product(1 + net_return)', 'gross_to_net_total_return_drag')}, {r('avg(1 / greatest(concentration_hhi, 1e-12))', 'mean_effective_positions')} FROM daily""")  # fmt: skip
def trading_summary(spark, folder):
    names = ("total_total_cost", "total_l1_turnover", "mean_gross_exposure", "mean_active_positions", "annualized_cost_drag", "maximum_absolute_weight", "gross_to_net_total_return_drag", "mean_effective_positions")
    return shown(pf.trading_summary(daily(spark, folder)).select(*names))


@register("portfolio_exposures", f"WITH {DAILY} " + " UNION ALL ".join(f"SELECT '{c}' AS exposure, {r(f'median({c})', 'median')}, {r(f'min({c})', 'minimum')}, {r(f'max({c})', 'maximum')}, {r(f'quantile_cont({c}, 0.01)', 'p01')}, {r(f'quantile_cont({c}, 0.99)', 'p99')} FROM daily" for c in ("gross_exposure", "net_exposure", "long_exposure", "short_exposure")))
def exposures(spark, folder):
    return shown(pf.exposure_summary(daily(spark, folder)))


@register("portfolio_attribution", f"""WITH {DAILY}, c AS (SELECT d, CAST(e AS VARCHAR) AS asset, weight, weight * x AS y FROM w UNION ALL SELECT d, 'Cash', cash_weight, cash_contribution FROM daily), j AS (SELECT c.*, gross_return AS g FROM c JOIN daily USING (d))
SELECT asset, {r('sum(y)', 'total_contribution')}, {r('avg(y)', 'mean_contribution')}, {r('sum(CASE WHEN weight > 0 THEN y ELSE 0 END)', 'long_contribution')}, {r('sum(CASE WHEN weight < 0 THEN y ELSE 0 END)', 'short_contribution')},
 {r('avg(abs(weight))', 'mean_absolute_weight')}, {r('max(abs(weight))', 'maximum_absolute_weight')}, count(*) FILTER (abs(weight) > 1e-12) AS active_periods, {r('covar_samp(y, g) / NULLIF(var_samp(g), 0)', 'risk_share')} FROM j GROUP BY asset""")  # fmt: skip
def attribution(spark, folder):
    w = weighted(spark, folder)
    return shown(pf.attribute_assets(w, daily(spark, folder), "d", "e"))


@register("portfolio_training_turnover", f"WITH {DAILY}, tt AS (SELECT d, l1_turnover AS t, row_number() OVER (ORDER BY d) AS n FROM daily) SELECT d, {r('CASE WHEN n > 1 THEN t ELSE coalesce((SELECT avg(t) FROM tt WHERE n > 1), 0) END', 'training_turnover')} FROM tt")
def training_turnover(spark, folder):
    return shown(pf.training_turnover(daily(spark, folder), "d").select("d", "training_turnover"))


@register("portfolio_objective", f"WITH {DAILY} SELECT {r('-(avg(gross_return) - 2 * var_pop(gross_return) - 0.1 * avg(concentration_hhi) - avg(total_cost) - 0.5 * avg(pow(greatest(abs(net_exposure) - 0.05, 0), 2)))', 'loss')} FROM daily")
def objective(spark, folder):
    return shown(pf.objective(daily(spark, folder), 2.0, 0.1, 0.05, 0.5))


@register("portfolio_autocorrelation", f"WITH {DAILY}, ac AS (SELECT net_return AS x, lag(net_return) OVER (ORDER BY d) AS y FROM daily) SELECT {r('corr(x, y)', 'autocorrelation_1')} FROM ac")
def autocorrelation(spark, folder):
    return shown(pf.autocorrelation(daily(spark, folder), "d"))


@register("portfolio_drawdown_window", f"WITH {PATH.replace('net_return AS r, product(1 + net_return)', 'gross_return AS r, product(1 + gross_return)')}, tr AS (SELECT d AS trough FROM path ORDER BY drawdown, d LIMIT 1) SELECT trough, max(d) FILTER (abs(drawdown) <= 1e-12 AND d < trough) AS peak FROM path, tr GROUP BY trough")
def drawdown_window(spark, folder):
    return pf.drawdown_window(daily(spark, folder), "d").select("trough", "peak")


@register("portfolio_period_summary", f"WITH {DAILY}, " + ", ".join(f"y_{p}_{k} AS (SELECT date_trunc('{p}', d) AS period, product(1 + {k}_return) - 1 AS r FROM daily GROUP BY 1)" for p in ("month", "year") for k in ("gross", "net")) + " " + " UNION ALL ".join(f"SELECT '{p}' AS period, '{k}' AS kind, {r('avg(CAST(r > 0 AS DOUBLE))', 'positive_rate')}, {r('max(r)', 'best')}, {r('min(r)', 'worst')} FROM y_{p}_{k}" for p in ("month", "year") for k in ("gross", "net")))
def period_summary(spark, folder):
    return shown(compare.period_summary(daily(spark, folder), "d"))


@register("portfolio_contribution_concentration", f"""WITH {DAILY}, y AS (SELECT e, abs(sum(weight * x)) AS ret, coalesce(abs(covar_samp(weight * x, gross_return) / var_samp(gross_return)), 0) AS risk FROM w JOIN daily USING (d) GROUP BY e),
k AS (SELECT 'return' AS kind, ret AS v, row_number() OVER (ORDER BY ret DESC) AS k FROM y UNION ALL SELECT 'risk', risk, row_number() OVER (ORDER BY risk DESC) FROM y)
SELECT kind, {r('sum(v * v) / (sum(v) * sum(v))', 'hhi')}, {r('sum(v) FILTER (k <= 1) / sum(v)', 'top1_share')}, {r('sum(v) FILTER (k <= 5) / sum(v)', 'top5_share')}, {r('sum(v) FILTER (k <= 10) / sum(v)', 'top10_share')} FROM k GROUP BY kind""")  # fmt: skip
def contribution_concentration(spark, folder):
    assets = pf.attribute_assets(weighted(spark, folder), daily(spark, folder), "d", "e").where("asset <> 'Cash'")
    return shown(compare.contribution_concentration(assets))


@register("portfolio_rolling_performance", f"""WITH {DAILY}, k AS (SELECT d, net_return AS x, net_return - rf AS y FROM daily), q AS (SELECT d, count(*) OVER w AS n, product(1 + x) OVER w - 1 AS ret, stddev_samp(x) OVER w * sqrt(252) AS vol, avg(y) OVER w / stddev_samp(y) OVER w * sqrt(252) AS sharpe, quantile_cont(-x, 0.9) OVER w AS var_90, list(-x) OVER w AS losses FROM k WINDOW w AS (ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT d, {', '.join(r(f'CASE WHEN n = 10 THEN {x} END', c) for c, x in (('rolling_return', 'ret'), ('rolling_volatility', 'vol'), ('rolling_sharpe', 'sharpe'), ('var_90', 'var_90'), ('expected_shortfall_90', 'list_avg(list_filter(losses, lambda z: z >= var_90))')))} FROM q""")  # fmt: skip
def rolling_performance(spark, folder):
    return shown(pf.rolling_performance(daily(spark, folder), "d", 10, levels=(0.9,)))


SIDES = {"long": "long_contribution", "short": "short_contribution", "cash": "cash_contribution", "transaction_costs": "-transaction_cost", "borrow_costs": "-borrow_cost"}


@register("portfolio_side_attribution", f"WITH {DAILY} " + " UNION ALL ".join(f"SELECT '{k}' AS source, {r(f'sum({x})', 'total_contribution')}, {r(f'avg({x})', 'mean_daily_contribution')} FROM daily" for k, x in SIDES.items()))
def side_attribution(spark, folder):
    return shown(pf.attribute_sides(daily(spark, folder)))


@register("portfolio_drawdown_attribution", f"""WITH {PATH}, tr AS (SELECT d AS trough FROM path ORDER BY drawdown, d LIMIT 1), pk AS (SELECT trough, max(d) FILTER (abs(drawdown) <= 1e-12 AND d < trough) AS peak FROM path, tr GROUP BY trough),
i AS (SELECT daily.* FROM daily, pk WHERE d <= trough AND (peak IS NULL OR d > peak)), c AS (SELECT CAST(e AS VARCHAR) AS asset, weight * x AS y FROM w JOIN i USING (d) UNION ALL SELECT 'Cash', cash_contribution FROM i UNION ALL SELECT 'Costs', -total_cost FROM i)
SELECT asset, {r('sum(y)', 'contribution')} FROM c GROUP BY asset""")  # fmt: skip
def drawdown_attribution(spark, folder):
    return shown(pf.attribute_drawdown(weighted(spark, folder), daily(spark, folder), "d", "e"))


@register("portfolio_leg_summary", f"WITH {DAILY} " + " UNION ALL ".join(f"SELECT '{k}' AS side, {r(f'product(1 + {x}) - 1', 'total_return')}, {r(f'avg({x}) * 252', 'annualized_return')}, {r(f'stddev_samp({x}) * sqrt(252)', 'annualized_volatility')} FROM daily" for k in ("long", "short") for x in (f"CASE WHEN {k}_exposure > 1e-12 THEN {k}_contribution / {k}_exposure ELSE 0 END",)))
def leg_summary(spark, folder):
    return shown(pf.leg_summary(daily(spark, folder)))


@register("portfolio_reconciliation", f"WITH {DAILY} SELECT {r('max(abs(long_contribution + short_contribution + cash_contribution - gross_return))', 'gross_gap')}, {r('max(abs(gross_return - total_cost - net_return))', 'net_gap')} FROM daily")
def reconciliation(spark, folder):
    return shown(pf.reconciliation(daily(spark, folder)))
