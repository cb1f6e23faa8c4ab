"""Tests and regressions on any number of date series at once, with errors that allow for autocorrelation.

A series is what rows with equal ``by`` columns give in the order of ``time``, one row a date. Lagged cross sums come from
one window a series, all sums from grouped aggregates; only the small matrices of a series (one row each) are solved by
NumPy, in the executors. Nothing is collected but the length of the longest series, which bounds the lags of means and joint tests;
regressions need no bound.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement
from math import floor, isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import EPS
from ..functions.columns import finite, guarded_ratio
from . import inference


def bandwidth(n: Column) -> Column:
    """Lags that the automatic rule takes for ``n`` rows."""
    return F.when(n < 2, 0).otherwise(F.floor(4 * F.pow(n / 100.0, 2.0 / 9))).cast("int")


def _complete(df: DataFrame, by: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """Rows where every column is a finite number, as doubles."""
    rows = df.select(*by, time, *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    return rows.dropna(subset=list(columns))


def _most_lags(rows: DataFrame, by: Sequence[str], lag: int | None) -> int:
    """Lags that the longest series needs: one number for the driver."""
    longest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    return min(lag, max(0, longest - 1)) if lag is not None else inference.bandwidth(longest)


def _weights(n: Column, lag: int | None, most: int) -> list[Column]:
    """Bartlett weights of the lags 1 to ``most``; zero beyond a series' own bandwidth."""
    own = F.lit(lag) if lag is not None else bandwidth(n)
    return [F.greatest(F.lit(0.0), 1 - F.lit(float(k)) / (own + 1)) for k in range(1, most + 1)]


def _lagged(c: Column, weights: list[Column], w: object) -> Column:
    """Weighted sum of the earlier values of ``c``."""
    terms = [x * F.coalesce(F.lag(c, k).over(w), F.lit(0.0)) for k, x in enumerate(weights, 1)] or [F.lit(0.0)]
    while len(terms) > 1:  # a flat tree, however many lags are asked for
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) & ~1 :]
    return terms[0]


def _bartlett(columns: Sequence[Column], by: str, lags: Column) -> list[Column]:
    """Of each column the value of a row and the Bartlett-weighted earlier ones; ``_i`` numbers the rows of a series, ``lags`` is one number a series.

    Numbers are divided by a little more than the lags, so a range of 1 back holds just these. A weight falls evenly with the
    number, so two sums over that range are all it takes, however many lags a series has.
    """
    back = Window.partitionBy(by).orderBy(F.col("_i") / (lags + 0.5)).rangeBetween(-1, 0)
    return [((lags + 1 - F.col("_i")) * F.sum(c).over(back) + F.sum(F.col("_i") * c).over(back)) / (lags + 1) for c in columns]


def _per_row(f: Callable[..., object], returns: str) -> Callable[..., Column]:
    """``f`` on the numbers or lists of one row, for tables with a row a series; null where it gives None or NaN."""

    list_ = returns == "array<double>"
    kind = pa.list_(pa.float64()) if list_ else pa.float64()

    @F.arrow_udf(ArrayType(DoubleType()) if list_ else DoubleType())
    def over(*columns: pa.Array) -> pa.Array:
        out = [f(*row) if all(x is not None for x in row) else None for row in zip(*[c.to_pylist() for c in columns], strict=True)]
        return pa.array([None if isinstance(x, float) and x != x else x for x in out], kind)

    return over


student_p = _per_row(lambda t, df: inference.student_tail(t, df) if df > 0 else None, "double")
normal_p = _per_row(lambda z: inference.normal_tail(z) if isfinite(z) else None, "double")
chi2_p = _per_row(lambda x, k: inference.chi2_tail(x, int(k)), "double")


def sided(p: Column, t: Column, alternative: str) -> Column:
    """A two-sided p-value as that of one side."""
    if alternative == "two-sided":
        return p
    if alternative not in ("greater", "less"):
        raise ValueError(f"unknown alternative {alternative}")
    return F.when((t > 0) == (alternative == "greater"), p / 2).otherwise(1 - p / 2)


def hac_mean(df: DataFrame, by: Sequence[str], time: str, value: str, null: float = 0.0, lag: int | None = None, alternative: str = "two-sided") -> DataFrame:
    """Is the mean of each series ``null``? Returns ``by, mean, standard_error, t, p_value, n``.

    Missing and non-finite values don't count. Under two values, or without spread, there is no test: ``t`` and ``p_value`` are null
    (under two also ``mean``). The error is the root of the Bartlett-weighted long-run variance over n, Student's t has n - 1 degrees.
    """
    rows = _complete(df, by, time, [value])
    most = _most_lags(rows, by, lag)
    own = Window.partitionBy(*by)
    rows = rows.select(*by, time, F.col(value).alias("_x"), F.count("*").over(own).alias("_n"), (F.col(value) - F.avg(value).over(own)).alias("_d"))
    ahead = _lagged(F.col("_d"), _weights(F.col("_n"), lag, most), own.orderBy(time))
    sums = rows.select(*by, "_x", (F.col("_d") * (F.col("_d") + 2 * ahead)).alias("_v")).groupBy(*by).agg(F.count("*").alias("n"), F.avg("_x").alias("mean"), F.sum("_v").alias("_v"))
    enough = F.col("n") >= 2
    se = F.when(enough, F.sqrt(F.greatest(F.lit(0.0), F.col("_v"))) / F.col("n"))
    out = sums.select(*by, F.when(enough, F.col("mean")).alias("mean"), se.alias("standard_error"), "n")
    out = out.withColumn("t", F.when(F.col("standard_error") > EPS, (F.col("mean") - null) / F.col("standard_error")))
    p = student_p(F.col("t"), (F.col("n") - 1).cast("double"))
    return out.withColumn("p_value", sided(p, F.col("t"), alternative)).select(*by, "mean", "standard_error", "t", "p_value", "n")


def _matrix(a: Sequence[float], k: int) -> np.ndarray:
    """A symmetric matrix from its upper triangle, row by row."""
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = a
    return out + np.triu(out, 1).T


def _solve(gram: list[float], moments: list[float]) -> list[float]:
    """Coefficients, then the inverse row by row; of collinear columns the shortest solution."""
    k = len(moments)
    inverse = np.linalg.pinv(_matrix(gram, k), hermitian=True)
    return [*(inverse @ moments).tolist(), *inverse.ravel().tolist()]


def _sandwich(solved: list[float], meat: list[float], k: int) -> list[float]:
    inverse = np.asarray(solved[k:]).reshape(k, k)
    return (inverse @ _matrix(meat, k) @ inverse).ravel().tolist()


def _same(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, null being a key like others; ``b`` has a row a key."""
    other = b.withColumnsRenamed({c: f"_key_{i}" for i, c in enumerate(by)})
    on = [F.col(f"_key_{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)]
    return (a.join(other, on) if by else a.crossJoin(other)).drop(*[f"_key_{i}" for i in range(len(by))])


def _coefficients(rows: DataFrame, by: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """``by, n, _mean, _solved``: least squares with an intercept, for each series of complete rows."""
    z = [F.lit(1.0), *map(F.col, xs)]
    gram = F.array(*[F.sum(a * b) for a, b in combinations_with_replacement(z, 2)])
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(y).alias("_mean"), gram.alias("_gram"), F.array(*[F.sum(a * F.col(y)) for a in z]).alias("_moments"))
    return sums.select(*by, "n", "_mean", _per_row(_solve, "array<double>")("_gram", "_moments").alias("_solved"))


def regress(df: DataFrame, by: Sequence[str], time: str, y: str, xs: Sequence[str], lag: int | None = None) -> DataFrame:
    """Least squares of ``y`` on ``xs`` and an intercept for each series, with Newey-West covariance.

    Returns ``by, n, coefficients, covariance, errors, t, p_values, r_squared``. Arrays have the intercept first, ``covariance`` is row by
    row; p-values are normal and two-sided, null where an error is zero. Rows with a missing or non-finite number don't count; series
    without more rows than coefficients give null arrays. ``lag=None`` takes each series' own automatic bandwidth.

    Rows move once, by a key that is never null: sums, the join with what they solve to, and lags all find them where they are. Sums add
    values up in the order of time.
    """
    k, packed = len(xs) + 1, F.struct(*by, F.lit(0).alias("_"))
    rows = _complete(df, by, time, [y, *xs]).repartition(packed).select(packed.alias("_k"), time, y, *xs).sortWithinPartitions("_k", time)
    solved = _coefficients(rows, ["_k"], y, xs).withColumnRenamed("_k", "_key")
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_k").orderBy(time)))
    z = [F.lit(1.0), *map(F.col, xs)]
    fit = sum((F.get("_solved", F.lit(i)) * c for i, c in enumerate(z)), F.lit(0.0))
    joined = numbered.join(solved, F.col("_k") == F.col("_key")).withColumn("_e", F.col(y) - fit)
    once = F.when(F.col("_i") == 1, F.col("_solved")).alias("_solved")
    joined = joined.select("_k", "_i", "n", once, "_e", (F.col(y) - F.col("_mean")).alias("_d"), *[(c * F.col("_e")).alias(f"_u{i}") for i, c in enumerate(z)])
    u, s = [F.col(f"_u{i}") for i in range(k)], [F.col(f"_s{i}") for i in range(k)]
    lagged = _bartlett(u, "_k", bandwidth(F.col("n")) if lag is None else F.lit(lag))
    joined = joined.select("*", *[c.alias(f"_s{i}") for i, c in enumerate(lagged)])
    meat = F.array(*[F.sum(u[i] * s[j] + u[j] * s[i] - u[i] * u[j]) for i, j in combinations_with_replacement(range(k), 2)])
    sums = joined.groupBy("_k").agg(F.first("n").alias("n"), F.first("_solved", ignorenulls=True).alias("_solved"), meat.alias("_meat"), F.sum(F.col("_e") * F.col("_e")).alias("_sse"), F.sum(F.col("_d") * F.col("_d")).alias("_sst"))
    enough = F.col("n") > k
    out = sums.select(
        *[F.col("_k")[c].alias(c) for c in by], "n", F.when(enough, F.slice("_solved", 1, k)).alias("coefficients"), F.when(enough, _per_row(lambda a, b: _sandwich(a, b, k), "array<double>")("_solved", "_meat")).alias("covariance"),
        F.when(enough & (F.col("_sst") > EPS * EPS), 1 - F.col("_sse") / F.col("_sst")).alias("r_squared"),
    )
    errors = F.array(*[F.sqrt(F.greatest(F.lit(0.0), F.get("covariance", F.lit(i * (k + 1))))) for i in range(k)])
    out = out.withColumn("errors", F.when(F.col("covariance").isNotNull(), errors))
    out = out.withColumn("t", F.zip_with("coefficients", "errors", lambda b, e: F.when(e > EPS, b / e)))
    p = _per_row(lambda ts: [None if t is None else inference.normal_tail(t) for t in ts], "array<double>")
    return out.select(*by, "n", "coefficients", "covariance", "errors", "t", p("t").alias("p_values"), "r_squared")


def _named(values: Column, names: Sequence[str], after: int = 1) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.slice(values, after + 1, len(names)))


def factor_alpha(df: DataFrame, by: Sequence[str], time: str, excess: str, factors: Sequence[str], periods: int = 252, lag: int | None = None) -> DataFrame:
    """Alpha and loadings of each series: ``by, alpha, annualized_alpha, standard_error, t, p_value, betas, beta_p_values, r_squared, n``.

    Series with too few complete rows to tell the coefficients are left out.
    """
    found = regress(df, by, time, excess, factors, lag).where(F.col("coefficients").isNotNull())
    first = {c: F.get(a, F.lit(0)) for c, a in (("alpha", "coefficients"), ("standard_error", "errors"), ("t", "t"), ("p_value", "p_values"))}
    return found.select(
        *by, first["alpha"].alias("alpha"), (first["alpha"] * periods).alias("annualized_alpha"), *[first[c].alias(c) for c in ("standard_error", "t", "p_value")],
        _named(F.col("coefficients"), factors).alias("betas"), _named(F.col("p_values"), factors).alias("beta_p_values"), "r_squared", "n",
    )


def timing_design(df: DataFrame, by: Sequence[str], time: str, excess: str, market: str, others: Sequence[str], instruments: DataFrame, lag: int = 1, square: bool = True, conditional_alpha: bool = True) -> tuple[DataFrame, list[str]]:
    """(rows, predictors) of the timing regression, before it is fitted.

    ``instruments`` has ``time`` and a column for each instrument; their values of ``lag`` dates earlier (in their own calendar) are joined
    by date. They are demeaned over the rows of a series where everything is there, so the intercept is the alpha in an average state.
    """
    z = [c for c in instruments.columns if c != time]
    if taken := set(z) & {*by, excess, market, *others}:
        raise ValueError(f"instruments share names with the panel: {sorted(taken)}")
    dates = Window.orderBy(time)  # one row a date
    shifted = instruments.select(time, *[F.lag(c, lag).over(dates).alias(c) if lag else F.col(c) for c in z])
    rows = _complete(df.select(*by, time, excess, market, *others).join(F.broadcast(shifted), time), by, time, [excess, market, *others, *z])
    own = Window.partitionBy(*by)
    rows = rows.select(*by, time, excess, market, *others, *[(F.col(c) - F.avg(c).over(own)).alias(c) for c in z])
    made = {f"alpha_{c}": F.col(c) for c in z} if conditional_alpha else {}
    made |= {market: F.col(market)} | {f"{market}_x_{c}": F.col(market) * F.col(c) for c in z} | {c: F.col(c) for c in others}
    made |= {f"{market}_squared": F.col(market) ** 2} if square else {}
    return rows.select(*by, time, excess, *[c.alias(n) for n, c in made.items()]), list(made)


def timing_model(df: DataFrame, by: Sequence[str], time: str, excess: str, market: str, others: Sequence[str], instruments: DataFrame, periods: int = 252, instrument_lag: int = 1, square: bool = True, conditional_alpha: bool = True, lag: int | None = None) -> DataFrame:
    """Conditional market timing of each series: market loading that moves with lagged instruments, convexity, and alpha.

    Returns ``by, alpha, alpha_p_value, annualized_alpha, market_beta, market_beta_p_value, timing_gamma, timing_p_value, r_squared, n,
    coefficients, p_values``, the last two by predictor name. Series with too few complete rows are left out.
    """
    if market not in df.columns:
        raise ValueError(f"no column {market}")
    rows, names = timing_design(df, by, time, excess, market, others, instruments, instrument_lag, square, conditional_alpha)
    found = regress(rows, by, time, excess, names, lag).where(F.col("coefficients").isNotNull() & (F.col("n") > len(names) + 1))

    def of(array: str, name: str) -> Column:
        return F.get(array, F.lit(names.index(name) + 1)) if name in names else F.lit(None).cast("double")

    gamma = f"{market}_squared"
    alpha = F.get("coefficients", F.lit(0))
    return found.select(
        *by, alpha.alias("alpha"), F.get("p_values", F.lit(0)).alias("alpha_p_value"), (alpha * periods).alias("annualized_alpha"), of("coefficients", market).alias("market_beta"), of("p_values", market).alias("market_beta_p_value"),
        of("coefficients", gamma).alias("timing_gamma"), of("p_values", gamma).alias("timing_p_value"), "r_squared", "n", _named(F.col("coefficients"), names).alias("coefficients"), _named(F.col("p_values"), names).alias("p_values"),
    )


def pair_differences(df: DataFrame, model: str, time: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """``a, b, time, difference`` and the date's columns ``keep``, for each unordered pair of models on the dates that both have."""
    left = df.select(F.col(model).alias("a"), time, F.col(value).alias("_a"), *keep)
    right = df.select(F.col(model).alias("b"), time, F.col(value).alias("_b"))
    return left.join(right, time).where("a < b").select("a", "b", time, (F.col("_a") - F.col("_b")).alias("difference"), *keep)


def alpha_difference(df: DataFrame, model: str, time: str, excess: str, factors: Sequence[str], lag: int | None = None) -> DataFrame:
    """``a, b, alpha_difference, standard_error, p_value, n`` of each pair of models: the alpha of their difference."""
    found = factor_alpha(pair_differences(df, model, time, excess, factors), ["a", "b"], time, "difference", factors, lag=lag)
    return found.select("a", "b", F.col("alpha").alias("alpha_difference"), "standard_error", "p_value", "n")


def spanning_test(df: DataFrame, by: Sequence[str], time: str, excess: str, benchmarks: Sequence[str], lag: int | None = None) -> DataFrame:
    """``by, statistic, p_value, n``: are alpha zero and the loadings' sum one, by a Wald test of two degrees? Short series are null."""

    def wald(b: list[float], cov: list[float]) -> float:
        k = len(b)
        r = np.zeros((2, k))
        r[0, 0], r[1, 1:] = 1, 1
        d = r @ b - np.array([0.0, 1.0])
        return float(d @ np.linalg.pinv(r @ np.asarray(cov).reshape(k, k) @ r.T) @ d)

    found = regress(df, by, time, excess, benchmarks, lag).withColumn("statistic", F.when(F.col("n") > len(benchmarks) + 2, _per_row(wald, "double")("coefficients", "covariance")))
    return found.select(*by, "statistic", chi2_p("statistic", F.lit(2.0)).alias("p_value"), "n")


def joint_alpha_test(df: DataFrame, by: Sequence[str], portfolio: str, time: str, excess: str, factors: Sequence[str], lag: int | None = None) -> DataFrame:
    """Are all alphas of a family's portfolios zero? ``by, statistic, p_value, portfolios, n`` for each family.

    Only dates count that every portfolio of the family has, complete with its factors. Portfolios that others span add nothing to
    the statistic and no degree; a family with too few dates is null.
    """
    rows = _complete(df, [*by, portfolio], time, [excess, *factors])
    sizes = rows.groupBy(*by).agg(F.countDistinct(portfolio).alias("m"))
    dates = rows.groupBy(*by, time).agg(F.array_sort(F.collect_list(F.struct(portfolio, excess))).alias("_y"), *[F.first(c).alias(c) for c in factors])
    dates = _same(dates, sizes, by).where(F.size("_y") == F.col("m"))
    long = dates.select(*by, time, *factors, "m", F.posexplode("_y").alias("_p", "_s")).select(*by, time, *factors, "m", "_p", F.col(f"_s.{excess}").alias("_v"))
    solved = _coefficients(long, [*by, "_p"], "_v", factors)
    z = [F.lit(1.0), *map(F.col, factors)]
    k = len(z)
    fit = sum((F.get("_solved", F.lit(i)) * c for i, c in enumerate(z)), F.lit(0.0))
    lean = sum((F.get("_solved", F.lit(k + i)) * c for i, c in enumerate(z)), F.lit(0.0))  # the intercept's row of the inverse
    moments = _same(long, solved, [*by, "_p"]).select(*by, time, "n", "m", "_p", F.get("_solved", F.lit(0)).alias("_alpha"), (lean * (F.col("_v") - fit)).alias("_u"))
    most = _most_lags(moments.where("_p = 0"), by, lag)
    series = Window.partitionBy(*by, "_p").orderBy(time)
    moments = moments.withColumn("_s", _lagged(F.col("_u"), _weights(F.col("n"), lag, most), series))
    packed = moments.groupBy(*by, time).agg(F.first("n").alias("n"), F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("_p", "_u", "_s", "_alpha"))).alias("_all"))
    pairs = packed.select(*by, "n", "m", F.explode("_all").alias("_i"), "_all").select(*by, "n", "m", "_i", F.explode("_all").alias("_j")).where("_i._p <= _j._p")
    cross = F.col("_i._u") * F.col("_j._u") + F.col("_i._u") * F.col("_j._s") + F.col("_j._u") * F.col("_i._s")
    cells = pairs.groupBy(*by, F.col("_i._p").alias("_a"), F.col("_j._p").alias("_b")).agg(F.sum(cross).alias("_v"), F.first("_i._alpha").alias("_alpha"), F.first("n").alias("n"), F.first("m").alias("m"))
    family = cells.groupBy(*by).agg(F.first("n").alias("n"), F.first("m").alias("portfolios"), F.transform(F.array_sort(F.collect_list(F.struct("_a", "_b", "_v"))), lambda x: x["_v"]).alias("_meat"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_a") == F.col("_b"), F.struct("_a", "_alpha")))), lambda x: x["_alpha"]).alias("_alphas"))

    def wald(meat: list[float], alphas: list[float]) -> list[float]:
        v = _matrix(meat, len(alphas))
        rank = int(np.linalg.matrix_rank(v, hermitian=True))
        return [float(np.asarray(alphas) @ np.linalg.pinv(v, hermitian=True) @ alphas), float(rank)]

    found = family.withColumn("_w", F.when(F.col("n") > F.col("portfolios") + len(factors) + 1, _per_row(wald, "array<double>")("_meat", "_alphas")))
    statistic, rank = F.get("_w", F.lit(0)), F.get("_w", F.lit(1))
    return found.select(*by, statistic.alias("statistic"), F.when(rank == 0, F.lit(1.0)).otherwise(chi2_p(statistic, F.greatest(rank, F.lit(1.0)))).alias("p_value"), "portfolios", "n")


def rolling_betas(df: DataFrame, by: Sequence[str], time: str, excess: str, factors: Sequence[str], window: int) -> DataFrame:
    """``by, time, alpha, betas``: least squares over the last ``window`` complete rows of each series, where there are so many."""
    if window <= len(factors) + 1:
        raise ValueError("a window needs more rows than the regression has coefficients")
    rows = _complete(df, by, time, [excess, *factors])
    z = [F.lit(1.0), *map(F.col, factors)]
    order = Window.partitionBy(*by).orderBy(time)
    last = order.rowsBetween(1 - window, 0)
    gram = F.array(*[F.sum(a * b).over(last) for a, b in combinations_with_replacement(z, 2)])
    sums = rows.select(*by, time, F.row_number().over(order).alias("_i"), gram.alias("_gram"), F.array(*[F.sum(a * F.col(excess)).over(last) for a in z]).alias("_moments")).where(F.col("_i") >= window)
    solved = sums.select(*by, time, _per_row(_solve, "array<double>")("_gram", "_moments").alias("_solved"))
    return solved.select(*by, time, F.get("_solved", F.lit(0)).alias("alpha"), _named(F.col("_solved"), factors).alias("betas"))


def cumulative_alpha(df: DataFrame, by: Sequence[str], time: str, excess: str, factors: Sequence[str]) -> DataFrame:
    """``by, time, abnormal, cumulative_alpha``: what the loadings of the whole series leave unexplained, added up over time.

    Series of fewer than two rows more than factors are left out.
    """
    rows = _complete(df, by, time, [excess, *factors])
    solved = _coefficients(rows, by, excess, factors).where(F.col("n") >= len(factors) + 2)
    explained = sum((F.get("_solved", F.lit(i + 1)) * F.col(c) for i, c in enumerate(factors)), F.lit(0.0))
    rows = _same(rows, solved, by).select(*by, time, (F.col(excess) - explained).alias("abnormal"))
    return rows.withColumn("cumulative_alpha", F.sum("abnormal").over(Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)))


def directional_accuracy(daily: DataFrame, by: Sequence[str], time: str, hit_rate: str, baseline: float = 0.5, lag: int | None = None) -> DataFrame:
    """Does the mean of daily hit rates beat ``baseline``? One-sided."""
    found = hac_mean(daily, by, time, hit_rate, baseline, lag, "greater")
    return found.select(*by, F.col("mean").alias("mean_hit_rate"), F.col("t").alias("hit_rate_t_statistic"), F.col("p_value").alias("hit_rate_p_value"), "n")


def excess_profitability(daily: DataFrame, by: Sequence[str], time: str, profit: str, lag: int | None = None) -> DataFrame:
    """Is the mean of daily excess profits above zero? One-sided."""
    found = hac_mean(daily, by, time, profit, 0.0, lag, "greater")
    return found.select(*by, F.col("mean").alias("excess_profitability"), F.col("t").alias("excess_profitability_t_statistic"), F.col("p_value").alias("excess_profitability_p_value"), "n")


def daily_excess_profit(panel: DataFrame, by: Sequence[str], time: str, score: str, ret: str) -> DataFrame:
    """``by, time, excess_profit, hit_rate, n``: of each date the covariance of the taken direction and the return, and the share of right signs.

    A direction is the sign of a score, zero counts as none; rows without both numbers don't count. A date with one row has no covariance.
    """
    rows = _complete(panel, by, time, [score, ret])
    sign, up = F.signum(score), F.signum(ret)
    return rows.groupBy(*by, time).agg(F.when(F.count("*") > 1, F.covar_pop(sign, F.col(ret))).alias("excess_profit"), F.avg((sign == up).cast("double")).alias("hit_rate"), F.count("*").alias("n"))


def information_coefficient(daily: DataFrame, by: Sequence[str], time: str, ic: str, periods: int = 252, lag: int | None = None, confidence: float = 0.95) -> DataFrame:
    """Mean of daily information coefficients, one-sided test, information ratio, and an interval by the error's normal quantiles."""
    spread = _complete(daily, by, time, [ic]).groupBy(*by).agg(F.stddev_samp(ic).alias("_sd"))
    found = _same(hac_mean(daily, by, time, ic, 0.0, lag, "greater"), spread, by)
    half, ir = F.lit(normal_quantile(0.5 + confidence / 2)) * F.col("standard_error"), guarded_ratio(F.col("mean"), F.col("_sd"))
    return found.select(
        *by, F.col("mean").alias("mean_ic"), F.col("t").alias("ic_t_statistic"), F.col("p_value").alias("ic_p_value"), ir.alias("information_ratio"), (ir * float(np.sqrt(periods))).alias("annualized_information_ratio"),
        (F.col("mean") - half).alias("ic_ci_low"), (F.col("mean") + half).alias("ic_ci_high"), "n",
    )


def normal_quantile(p: float) -> float:
    """By bisection; of constants only."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        tail = inference.normal_tail(mid) / 2
        low, high = (mid, high) if (1 - tail if mid > 0 else tail) < p else (low, mid)
    return (low + high) / 2


def pesaran_timmermann(df: DataFrame, by: Sequence[str], predicted_up: str, actual_up: str) -> DataFrame:
    """Do predicted directions follow the actual ones? ``by, hit_rate, expected_hit_rate, statistic, p_value, n``, all from five sums a series.

    Rows where a direction is missing don't count; without variation, or under two rows, there is no statistic. Normal, one-sided.
    """
    x, y = F.col(predicted_up).cast("double"), F.col(actual_up).cast("double")
    sums = df.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.avg((x == y).cast("double")).alias("hit_rate"))
    n, a, b = F.col("n"), F.col("_x"), F.col("_y")
    expected = a * b + (1 - a) * (1 - b)
    free = expected * (1 - expected) / n - ((2 * b - 1) ** 2 * a * (1 - a) + (2 * a - 1) ** 2 * b * (1 - b)) / n - 4 * a * b * (1 - a) * (1 - b) / n / n
    out = sums.select(*by, "hit_rate", expected.alias("expected_hit_rate"), F.when((n >= 2) & (free > EPS), (F.col("hit_rate") - expected) / F.sqrt(F.abs(free))).alias("statistic"), "n")
    return out.withColumn("p_value", sided(normal_p("statistic"), F.col("statistic"), "greater")).select(*by, "hit_rate", "expected_hit_rate", "statistic", "p_value", "n")


def diebold_mariano(daily: DataFrame, model: str, time: str, loss: str, horizon: int = 1, lag: int | None = None) -> DataFrame:
    """``a, b, mean_difference, statistic, p_value, n`` of each pair: is predictive loss equal? With the small-sample factor, two-sided t."""
    found = hac_mean(pair_differences(daily, model, time, loss), ["a", "b"], time, "difference", 0.0, horizon - 1 if lag is None else lag)
    n = F.col("n")
    factor = F.sqrt(F.greatest(F.lit(0.0), (n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n))
    out = found.withColumn("statistic", F.col("t") * factor)
    return out.select("a", "b", F.col("mean").alias("mean_difference"), "statistic", student_p(F.col("statistic"), (n - 1).cast("double")).alias("p_value"), "n")
