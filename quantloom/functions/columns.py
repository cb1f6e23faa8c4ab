"""Expressions that neither raise under ANSI rules nor let NaN through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

EPS = 1e-12


def finite(c: Column) -> Column:
    """NULL instead of NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def number(c: Column) -> Column:
    """A double where the text parses, else NULL."""
    return finite(c.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def guarded_ratio(a: Column, b: Column) -> Column:
    """NULL where the denominator is as good as zero."""
    return F.when(F.abs(b) > EPS, F.try_divide(a, b))


def over(c: Column, w: WindowSpec | None) -> Column:
    return c.over(w) if w is not None else c


def pearson(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Correlation over pairs where both are there; NULL on constants (``corr`` would raise)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = over(F.stddev_pop(a), w) * over(F.stddev_pop(b), w)
    return F.when(spread > EPS * EPS, F.try_divide(over(F.covar_pop(a, b), w), spread))


def average_rank(c: Column, by: list, present: Column | None = None) -> Column:
    """Ranks from 1 with ties sharing their mean, among rows where ``c`` is there."""
    from pyspark.sql import Window

    own = Window.partitionBy(*by, c.isNotNull())
    ties = Window.partitionBy(*by, c)
    return F.when(c.isNotNull(), F.rank().over(own.orderBy(c)) + (F.count(c).over(ties) - 1) / 2.0)


def skewness_unbiased(c: Column, w: WindowSpec | None = None) -> Column:
    """Sample skewness; NULL under four values or without spread."""
    n = over(F.count(c), w).cast("double")
    return F.when((n >= 4) & (over(F.stddev_samp(c), w) > EPS), over(F.skewness(c), w) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_unbiased(c: Column, w: WindowSpec | None = None) -> Column:
    """Sample excess kurtosis; NULL under four values or without spread."""
    n = over(F.count(c), w).cast("double")
    return F.when((n >= 4) & (over(F.stddev_samp(c), w) > EPS), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * over(F.kurtosis(c), w) + 6))


def product(c: Column, w: WindowSpec | None = None) -> Column:
    return over(F.product(c), w)


def rounded(c: Column, digits: int = 6) -> Column:
    """For comparisons between engines; without minus zero."""
    return F.round(c, digits) + F.lit(0.0)
