"""Portfolio weights, accounting by date, paths, and the catalogue of performance metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import EPS, guarded_ratio, kurtosis_unbiased, pearson, product, ratio, skewness_unbiased


def weights(df: DataFrame, time: str, score: str = "score", valid: str | None = None, how: str = "bounded", leverage: float = 1.0) -> DataFrame:
    """``weight``: scores as positions, by date.

    ``bounded`` leaves scores alone under the cap, ``gross`` scales to it, ``market_neutral`` takes the mean off first.
    Cells that aren't valid hold nothing.
    """
    w = Window.partitionBy(time)
    ok = (F.col(valid) if valid else F.lit(True)) & F.col(score).isNotNull()
    s = F.when(ok, F.col(score))
    if how == "market_neutral":
        df = df.withColumn("_s", s - F.avg(s).over(w))
    elif how in ("bounded", "gross"):
        df = df.withColumn("_s", s)
    else:
        raise ValueError(f"unknown weighting {how}")
    gross = F.coalesce(F.sum(F.abs("_s")).over(w), F.lit(0.0))
    scale = F.least(F.lit(1.0), leverage / F.greatest(gross, F.lit(EPS))) if how == "bounded" else F.when(gross > EPS, leverage / F.greatest(gross, F.lit(EPS))).otherwise(0.0)
    return df.withColumn("weight", F.coalesce(F.col("_s") * scale, F.lit(0.0))).drop("_s")


def simple_returns(c: Column, return_type: str) -> Column:
    """Simple returns from ``log`` or ``simple`` ones; a loss of everything or more raises."""
    r = F.expm1(c) if return_type == "log" else c
    return F.when(r <= -1, F.raise_error(F.lit("a return of -100 % or less")).cast("double")).otherwise(r)


def drifted(df: DataFrame, time: str, entity: str) -> DataFrame:
    """``drift``: what the previous date's target weight has become; ``trade``: the way to the new target.

    ``df`` is a dense grid with ``weight``, ``ret`` and ``rf``. The first date trades from nothing.
    """
    by_date, w = Window.partitionBy(time), Window.partitionBy(entity).orderBy(time)
    risky, net = F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).over(by_date), F.sum("weight").over(by_date)
    df = df.withColumn("_growth", F.greatest(1 + risky + (1 - net) * F.col("rf"), F.lit(EPS)))
    df = df.withColumn("_after", F.col("weight") * (1 + F.coalesce("ret", F.lit(0.0))) / F.col("_growth"))
    df = df.withColumn("drift", F.coalesce(F.lag("_after").over(w), F.lit(0.0)))
    return df.withColumn("trade", F.col("weight") - F.col("drift")).drop("_growth", "_after")


def account(df: DataFrame, time: str, entity: str, fee: float = 0.0, spread: float = 0.0, slippage: float = 0.0, borrow: float = 0.0, initial_trade: bool = True, active: float = EPS) -> DataFrame:
    """One row a date: returns, costs, exposures, turnover and composition of a dense grid with ``weight``, ``ret``, ``rf``."""
    d = drifted(df, time, entity).withColumn("_a", F.abs("weight"))
    by_date = Window.partitionBy(time)
    d = d.withColumn("_share", F.coalesce(ratio(F.col("_a"), F.sum("_a").over(by_date)), F.lit(0.0)))
    d = d.withColumn("_order", F.row_number().over(by_date.orderBy(F.desc("_a"), entity)))
    r = F.coalesce("ret", F.lit(0.0))
    long, short = F.greatest("weight", F.lit(0.0)), F.greatest(-F.col("weight"), F.lit(0.0))
    lw, sw = F.greatest(F.col("weight"), F.lit(0.0)), F.least(F.col("weight"), F.lit(0.0))
    ld, sd = F.greatest(F.col("drift"), F.lit(0.0)), F.least(F.col("drift"), F.lit(0.0))
    out = d.groupBy(time).agg(
        F.sum(F.col("weight") * r).alias("risky"), F.sum("weight").alias("net_exposure"), F.sum("_a").alias("gross_exposure"),
        F.sum(long).alias("long_exposure"), F.sum(short).alias("short_exposure"), F.first("rf").alias("rf"),
        F.sum(lw * r).alias("long_contribution"), F.sum(sw * r).alias("short_contribution"),
        F.sum(F.abs("trade")).alias("l1_turnover"), F.sum(F.abs(lw - ld)).alias("long_turnover"), F.sum(F.abs(sw - sd)).alias("short_turnover"),
        F.sum(F.col("_share") * F.col("_share")).alias("concentration_hhi"), F.max("_a").alias("largest_weight"),
        F.sum((F.col("_a") > active).cast("long")).alias("active_positions"), F.sum((F.col("weight") > active).cast("long")).alias("long_positions"), F.sum((F.col("weight") < -active).cast("long")).alias("short_positions"),
        F.sum(F.when(F.col("_order") <= 5, F.col("_share")).otherwise(0.0)).alias("top5_share"), F.sum(F.when(F.col("_order") <= 10, F.col("_share")).otherwise(0.0)).alias("top10_share"),
    )
    if not initial_trade:
        first = F.row_number().over(Window.orderBy(time)) == 1  # one row a date
        out = out.withColumn("_first", first).withColumns({c: F.when(F.col("_first"), 0.0).otherwise(F.col(c)) for c in ("l1_turnover", "long_turnover", "short_turnover")}).drop("_first")
    out = out.withColumn("cash_weight", 1 - F.col("net_exposure")).withColumn("cash_contribution", F.col("cash_weight") * F.col("rf"))
    out = out.withColumn("one_way_turnover", F.col("l1_turnover") / 2).withColumn("gross_return", F.col("risky") + F.col("cash_contribution"))
    out = out.withColumn("transaction_cost", F.col("l1_turnover") * (fee + spread + slippage)).withColumn("borrow_cost", F.col("short_exposure") * borrow)
    out = out.withColumn("total_cost", F.col("transaction_cost") + F.col("borrow_cost")).withColumn("net_return", F.col("gross_return") - F.col("total_cost"))
    out = out.withColumn("excess_return", F.col("net_return") - F.col("rf")).withColumn("effective_positions", 1 / F.greatest("concentration_hhi", F.lit(EPS)))
    return out.withColumn("long_return", ratio(F.col("long_contribution"), F.col("long_exposure"))).withColumn("short_return", ratio(F.col("short_contribution"), F.col("short_exposure")))


def training_turnover(daily: DataFrame, time: str) -> DataFrame:
    """Turnover as an objective sees it: the first date gets the mean of the others, zero when alone."""
    first = F.row_number().over(Window.orderBy(time)) == 1
    d = daily.withColumn("_t", F.when(~first, F.col("l1_turnover")))
    return d.withColumn("training_turnover", F.coalesce("_t", F.avg("_t").over(Window.partitionBy()), F.lit(0.0))).drop("_t")


def objective(daily: DataFrame, risk_aversion: float = 0.0, concentration_aversion: float = 0.0, net_tolerance: float = 0.0, net_penalty: float = 0.0) -> DataFrame:
    """The portfolio objective's value over the dates: what a fit would lower."""
    over = F.greatest(F.abs("net_exposure") - net_tolerance, F.lit(0.0))
    return daily.agg((-(F.avg("gross_return") - risk_aversion * F.var_pop("gross_return") - concentration_aversion * F.avg("concentration_hhi") - F.avg("total_cost") - net_penalty * F.avg(over * over))).alias("loss"))


def paths(daily: DataFrame, time: str, ret: str = "net_return") -> DataFrame:
    """Wealth, high-water mark (1 at least), drawdown and dates under water. ``daily`` has one row a date."""
    w = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("wealth", product(1 + F.col(ret), w))
    d = d.withColumn("high_water", F.greatest(F.max("wealth").over(w), F.lit(1.0)))
    d = d.withColumn("drawdown", F.col("wealth") / F.col("high_water") - 1)
    d = d.withColumn("_n", F.row_number().over(Window.orderBy(time)))
    last = F.coalesce(F.max(F.when(F.col("drawdown") >= 0, F.col("_n"))).over(w), F.lit(0))
    return d.withColumn("underwater", F.col("_n") - last).drop("_n")


def runs(df: DataFrame, flag: Column, order: list[str], by: list[str] | None = None) -> DataFrame:
    """``length`` of each maximal run of rows where ``flag`` holds, within ``by``."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    d = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    d = d.withColumn("_run", F.sum(F.when(F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where("_f").groupBy(*(by or []), "_run").agg(F.count("*").alias("length")).drop("_run")


def holding_period(df: DataFrame, time: str, entity: str, active: float = EPS) -> DataFrame:
    return runs(df, F.abs("weight") > active, [time], [entity]).agg(F.avg("length").alias("average_position_holding_period"))


def rolling_compound(daily: DataFrame, time: str, window: int, ret: str = "net_return") -> DataFrame:
    w = Window.orderBy(time).rowsBetween(-(window - 1), 0)
    return daily.withColumn(f"rolling_{window}", F.when(F.count(ret).over(w) == window, product(1 + F.col(ret), w) - 1))


def period_returns(daily: DataFrame, time: str, period: str, ret: str = "net_return") -> DataFrame:
    """Compound returns by ``month`` or ``year``."""
    return daily.groupBy(F.to_date(F.trunc(time, period)).alias("period")).agg((F.product(1 + F.col(ret)) - 1).alias("period_return"))


def autocorrelation(daily: DataFrame, time: str, lags: tuple[int, ...] = (1,), ret: str = "net_return") -> DataFrame:
    w = Window.orderBy(time)
    d = daily.select(ret, *[F.lag(ret, k).over(w).alias(f"_l{k}") for k in lags])
    return d.agg(*[pearson(F.col(ret), F.col(f"_l{k}")).alias(f"autocorrelation_{k}") for k in lags])


def performance(daily: DataFrame, time: str, ret: str = "net_return", periods: int = 252, minimum: float = 0.0, levels: tuple[float, ...] = (0.95, 0.99), rolling: int = 21) -> DataFrame:
    """One row of metrics of a return series; ``daily`` has one row a date and ``rf``."""
    m = (1 + minimum) ** (1 / periods) - 1
    p = rolling_compound(paths(daily.where(F.col(ret).isNotNull()), time, ret), time, rolling, ret)
    r, dd, n = F.col(ret), F.col("drawdown"), F.count(ret)
    risk = {f"_v{k}": F.percentile(-r, F.lit(lv)) for k, lv in enumerate(levels)}
    # tails need the quantile first: one value over all dates, broadcast by a global window on the date series
    p = p.withColumns({k: x.over(Window.partitionBy()) for k, x in risk.items()})
    excess = r - F.col("rf")
    down = F.sqrt(F.avg(F.pow(F.least(r - m, F.lit(0.0)), 2)))
    out = p.agg(
        n.alias("observations"), (F.product(1 + r) - 1).alias("total_return"), (F.pow(F.product(1 + r), F.lit(periods) / n) - 1).alias("cagr"),
        (F.avg(r) * periods).alias("annualized_arithmetic_return"), (F.stddev_samp(r) * periods**0.5).alias("annualized_volatility"), (down * periods**0.5).alias("downside_deviation"),
        F.when(F.stddev_samp(excess) > EPS, F.avg(excess) / F.stddev_samp(excess) * periods**0.5).alias("sharpe_ratio"), (guarded_ratio(F.avg(r) - m, down) * periods**0.5).alias("sortino_ratio"),
        guarded_ratio(F.sum(F.greatest(r - m, F.lit(0.0))), F.sum(F.greatest(m - r, F.lit(0.0)))).alias("omega_ratio"),
        F.min(dd).alias("maximum_drawdown"), F.coalesce(F.avg(F.when(dd < 0, dd)), F.lit(0.0)).alias("average_underwater_drawdown"), F.max("underwater").alias("maximum_drawdown_duration"),
        F.avg((dd < 0).cast("double")).alias("time_under_water"), F.sqrt(F.avg(dd * dd)).alias("ulcer_index"), skewness_unbiased(r).alias("skewness"), kurtosis_unbiased(r).alias("excess_kurtosis"),
        F.avg((r > 0).cast("double")).alias("positive_period_rate"), F.avg(F.when(r > 0, r)).alias("average_win"), F.avg(F.when(r < 0, r)).alias("average_loss"),
        guarded_ratio(F.avg(F.when(r > 0, r)), F.abs(F.avg(F.when(r < 0, r)))).alias("payoff_ratio"), guarded_ratio(F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))).alias("profit_factor"),
        F.avg(r).alias("expected_return_per_period"), F.max(r).alias("largest_win"), F.min(r).alias("largest_loss"),
        guarded_ratio(F.percentile(r, F.lit(0.95)), F.abs(F.percentile(r, F.lit(0.05)))).alias("tail_ratio"), F.min(f"rolling_{rolling}").alias(f"worst_rolling_{rolling}"),
        *[F.first(f"_v{k}").alias(f"var_{round(lv * 100)}") for k, lv in enumerate(levels)],
        *[F.avg(F.when(-r >= F.col(f"_v{k}"), -r)).alias(f"expected_shortfall_{round(lv * 100)}") for k, lv in enumerate(levels)],
    )
    return out.withColumn("calmar_ratio", guarded_ratio(F.col("cagr"), F.abs("maximum_drawdown")))


def streaks(daily: DataFrame, time: str, ret: str = "net_return") -> DataFrame:
    """Longest runs of wins and losses, and how long drawdowns last."""
    p = paths(daily, time, ret)
    wins = runs(p, F.col(ret) > 0, [time]).agg(F.coalesce(F.max("length"), F.lit(0)).alias("maximum_consecutive_wins"))
    losses = runs(p, F.col(ret) < 0, [time]).agg(F.coalesce(F.max("length"), F.lit(0)).alias("maximum_consecutive_losses"))
    down = runs(p, F.col("drawdown") < 0, [time]).agg(F.coalesce(F.avg("length"), F.lit(0.0)).alias("average_drawdown_duration"), F.coalesce(F.max("length"), F.lit(0)).alias("longest_drawdown"))
    key = [x.withColumn("_k", F.lit(1)) for x in (wins, losses, down)]
    return key[0].join(key[1], "_k").join(key[2], "_k").drop("_k")


def trading_summary(daily: DataFrame, periods: int = 252) -> DataFrame:
    """Totals and means of costs, turnover, exposures and composition over the dates."""
    total = {f"total_{c}": F.sum(c) for c in ("total_cost", "transaction_cost", "borrow_cost", "l1_turnover", "one_way_turnover", "long_turnover", "short_turnover", "long_contribution", "short_contribution", "cash_contribution")}
    mean = {f"mean_{c}": F.avg(c) for c in ("gross_exposure", "net_exposure", "long_exposure", "short_exposure", "cash_weight", "active_positions", "long_positions", "short_positions", "concentration_hhi", "effective_positions", "l1_turnover", "one_way_turnover", "long_turnover", "short_turnover")}
    annual = {"annualized_cost_drag": F.avg("total_cost") * periods, "annualized_l1_turnover": F.avg("l1_turnover") * periods, "maximum_absolute_weight": F.max("largest_weight")}
    annual |= {f"annualized_{c}": F.avg(c) * periods for c in ("long_contribution", "short_contribution", "cash_contribution")}
    drag = (F.product(1 + F.col("gross_return")) - F.product(1 + F.col("net_return"))).alias("gross_to_net_total_return_drag")
    return daily.agg(*[x.alias(n) for n, x in (total | mean | annual).items()], drag)


def exposure_summary(daily: DataFrame) -> DataFrame:
    """Median, extremes and outer percentiles of each exposure, long."""
    names = ("gross_exposure", "net_exposure", "long_exposure", "short_exposure")
    parts = [F.struct(F.lit(c).alias("exposure"), F.percentile(c, F.lit(0.5)).alias("median"), F.min(c).alias("minimum"), F.max(c).alias("maximum"), F.percentile(c, F.lit(0.01)).alias("p01"), F.percentile(c, F.lit(0.99)).alias("p99")) for c in names]
    return daily.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def attribute_assets(df: DataFrame, daily: DataFrame, time: str, entity: str, active: float = EPS) -> DataFrame:
    """Contribution of each asset, and of cash, to return and risk; ``entity`` comes out as text, cash as ``Cash``."""
    c = df.withColumn("contribution", F.col("weight") * F.coalesce("ret", F.lit(0.0))).select(F.col(time), F.col(entity).cast("string").alias("asset"), "weight", "contribution")
    cash = daily.select(time, F.lit("Cash").alias("asset"), F.col("cash_weight").alias("weight"), F.col("cash_contribution").alias("contribution"))
    both = c.unionByName(cash).join(daily.select(time, "gross_return"), time)
    by = both.groupBy("asset").agg(
        F.sum("contribution").alias("total_contribution"), F.avg("contribution").alias("mean_contribution"),
        F.sum(F.when(F.col("weight") > 0, F.col("contribution")).otherwise(0.0)).alias("long_contribution"), F.sum(F.when(F.col("weight") < 0, F.col("contribution")).otherwise(0.0)).alias("short_contribution"),
        F.avg(F.abs("weight")).alias("mean_absolute_weight"), F.max(F.abs("weight")).alias("maximum_absolute_weight"), F.sum((F.abs("weight") > active).cast("long")).alias("active_periods"),
        F.try_divide(F.covar_samp("contribution", "gross_return"), F.var_samp("gross_return")).alias("risk_share"),
    )
    return by


def drawdown_window(daily: DataFrame, time: str, ret: str = "gross_return") -> DataFrame:
    """``peak`` (NULL: before the sample) and ``trough`` of the deepest drawdown."""
    p = paths(daily, time, ret)
    trough = p.agg(F.min_by(time, F.struct("drawdown", F.col(time))).alias("trough"))
    return p.join(F.broadcast(trough), p[time] < F.col("trough"), "right").groupBy("trough").agg(F.max(F.when(F.abs("drawdown") <= EPS, F.col(time))).alias("peak"))


def rolling_performance(daily: DataFrame, time: str, window: int, ret: str = "net_return", periods: int = 252, levels: tuple[float, ...] = (0.95,)) -> DataFrame:
    """By date, over full trailing windows: compound return, volatility, ratio of excess return, value at risk and expected shortfall.

    ``daily`` has one row a date and ``rf``. A tail is all losses at or beyond the window's linear quantile.
    """
    w = Window.orderBy(time).rowsBetween(-(window - 1), 0)
    full, excess = F.count(ret).over(w) == window, F.col(ret) - F.col("rf")
    spread = F.stddev_samp(excess).over(w)
    d = daily.select(
        time, F.when(full, product(1 + F.col(ret), w) - 1).alias("rolling_return"), F.when(full, F.stddev_samp(ret).over(w) * periods**0.5).alias("rolling_volatility"),
        F.when(full & (spread > EPS), F.avg(excess).over(w) / spread * periods**0.5).alias("rolling_sharpe"), F.when(full, F.collect_list(-F.col(ret)).over(w)).alias("_losses"),
        *[F.when(full, F.percentile(-F.col(ret), F.lit(lv)).over(w)).alias(f"var_{round(lv * 100)}") for lv in levels],
    )
    for lv in levels:
        quantile = F.col(f"var_{round(lv * 100)}")
        tail = F.filter("_losses", lambda x: x >= quantile)  # noqa: B023
        d = d.withColumn(f"expected_shortfall_{round(lv * 100)}", F.try_divide(F.aggregate(tail, F.lit(0.0), lambda a, x: a + x), F.size(tail)))
    return d.drop("_losses")


def attribute_sides(daily: DataFrame) -> DataFrame:
    """``source, total_contribution, mean_daily_contribution`` of longs, shorts and cash, and of costs with a minus."""
    sources = {"long": F.col("long_contribution"), "short": F.col("short_contribution"), "cash": F.col("cash_contribution"), "transaction_costs": -F.col("transaction_cost"), "borrow_costs": -F.col("borrow_cost")}
    parts = [F.struct(F.lit(k).alias("source"), F.sum(c).alias("total_contribution"), F.avg(c).alias("mean_daily_contribution")) for k, c in sources.items()]
    return daily.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def attribute_drawdown(df: DataFrame, daily: DataFrame, time: str, entity: str, ret: str = "net_return") -> DataFrame:
    """``asset, contribution`` between the peak, which is left out, and the trough of the deepest drawdown; cash is ``Cash``, costs are ``Costs``."""
    inside = drawdown_window(daily, time, ret)
    dates = daily.join(F.broadcast(inside), (F.col(time) <= F.col("trough")) & (F.col("peak").isNull() | (F.col(time) > F.col("peak")))).select(time, "cash_contribution", "total_cost")
    assets = df.join(dates.select(time), time).select(F.col(entity).cast("string").alias("asset"), (F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("contribution"))
    both = [dates.select(F.lit("Cash").alias("asset"), F.col("cash_contribution").alias("contribution")), dates.select(F.lit("Costs").alias("asset"), (-F.col("total_cost")).alias("contribution"))]
    return assets.unionByName(both[0]).unionByName(both[1]).groupBy("asset").agg(F.sum("contribution").alias("contribution"))


def leg_summary(daily: DataFrame, periods: int = 252) -> DataFrame:
    """``side, total_return, annualized_return, annualized_volatility`` of the long and the short leg; a day without a leg counts as zero."""
    parts = []
    for side in ("long", "short"):
        r = F.coalesce(F.try_divide(F.col(f"{side}_contribution"), F.when(F.col(f"{side}_exposure") > EPS, F.col(f"{side}_exposure"))), F.lit(0.0))
        parts.append(F.struct(F.lit(side).alias("side"), (F.product(1 + r) - 1).alias("total_return"), (F.avg(r) * periods).alias("annualized_return"), (F.stddev_samp(r) * periods**0.5).alias("annualized_volatility")))
    return daily.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def reconciliation(daily: DataFrame) -> DataFrame:
    """Largest gap between the gross return and its contributions, and between the net return and gross return less costs."""
    gross = F.abs(F.col("long_contribution") + F.col("short_contribution") + F.col("cash_contribution") - F.col("gross_return"))
    return daily.agg(F.max(gross).alias("gross_gap"), F.max(F.abs(F.col("gross_return") - F.col("total_cost") - F.col("net_return"))).alias("net_gap"))


def check_reconciliation(daily: DataFrame, most: float = 1e-10) -> None:
    gaps = reconciliation(daily).first()
    if max(gaps.gross_gap or 0.0, gaps.net_gap or 0.0) > most:
        raise ValueError(f"contributions and returns differ by {gaps.gross_gap} (gross) and {gaps.net_gap} (net)")


def evaluate(df: DataFrame, time: str, entity: str, rolling: int = 63, levels: tuple[float, ...] = (0.95, 0.99), periods: int = 252, **costs: float) -> dict[str, DataFrame]:
    """All tables of a portfolio's evaluation from ``time, entity, weight, ret, rf``, by name; raises where accounts don't reconcile.

    ``costs`` go to ``account``. Everything but the accounts themselves is computed on one row a date.
    """
    daily = account(df, time, entity, **costs)
    check_reconciliation(daily)
    return {
        "daily": daily, "paths": paths(daily, time), "gross": performance(daily, time, "gross_return", periods, levels=levels), "net": performance(daily, time, "net_return", periods, levels=levels),
        "rolling": rolling_performance(daily, time, rolling, periods=periods, levels=levels), "monthly": period_returns(daily, time, "month"), "yearly": period_returns(daily, time, "year"),
        "trading": trading_summary(daily, periods), "exposures": exposure_summary(daily), "legs": leg_summary(daily, periods), "streaks": streaks(daily, time), "holding": holding_period(df, time, entity),
        "sides": attribute_sides(daily), "assets": attribute_assets(df, daily, time, entity), "drawdown": attribute_drawdown(df, daily, time, entity),
    }
