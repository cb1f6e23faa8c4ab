"""The factor section of a comparison: which series to regress on, every model's regressions at once, and the tables they fill."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..panel import Panel
from . import series_tests as st
from . import signals
from .align import align_risk_free


@dataclass(frozen=True)
class Design:
    """What is regressed on what. ``scale`` turns stored benchmark returns into decimals; ``benchmarks_excess`` takes the risk-free rate off them."""

    factors: tuple[str, ...]
    market: str
    benchmarks: tuple[str, ...] = ()
    scale: float = 0.01
    benchmarks_excess: bool = True
    instruments: tuple[str, ...] = ()
    instrument_lag: int = 1
    square: bool = True
    conditional_alpha: bool = True
    window: int = 252
    periods: int = 252
    lag: int | None = None
    correction: str = "holm"

    def __post_init__(self) -> None:
        odd = []
        if not self.factors or len(set(self.factors)) < len(self.factors):
            odd.append("factors have to be there and differ")
        if self.market not in self.factors:
            odd.append(f"the market {self.market} is no factor")
        if self.window <= len(self.factors) + 1:
            odd.append("a window needs more rows than the regression has coefficients")
        if set(self.instruments) & set(self.factors) or len(set(self.instruments)) < len(self.instruments):
            odd.append("instruments have to differ, from factors too")
        if not 0 < abs(self.scale) < float("inf") or self.periods < 1 or self.instrument_lag < 0 or (self.lag is not None and self.lag < 0):
            odd.append("scale, periods and lags are out of range")
        if self.correction not in ("holm", "bh", "none"):
            odd.append(f"unknown correction {self.correction}")
        if odd:
            raise ValueError("; ".join(odd))


def design_of(settings: Mapping) -> Design:
    """From plain settings; unknown keys are an error, lists become tuples."""
    known = Design.__dataclass_fields__
    if odd := sorted(set(settings) - set(known)):
        raise ValueError(f"unknown settings {odd}")
    return Design(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})


def _dated(panel: Panel, columns: Sequence[str], what: str) -> DataFrame:
    """Columns of a dataset with a row a date, complete rows only."""
    if panel.entity is not None:
        raise ValueError(f"{what} need a dataset with dates only")
    if missing := [c for c in columns if c not in panel.df.columns]:
        raise ValueError(f"{what} lack {missing}")
    return panel.df.select(panel.time, *[finite(F.col(c).cast("double")).alias(c) for c in columns])


@dataclass(frozen=True)
class Series:
    """Date-only frames to regress on, all under the name ``time`` of the first."""

    time: str
    factors: DataFrame
    benchmarks: DataFrame | None
    instruments: DataFrame | None


def series_for(design: Design, factors: Panel, benchmarks: Panel | None = None, instruments: Panel | None = None, risk_free: DataFrame | None = None) -> Series:
    """What ``design`` names, out of prepared datasets. Benchmarks are scaled and, where asked for, less the risk-free rate (``time, rf``) carried forward.

    Missing columns and datasets with entities are errors. Factors and benchmarks keep complete dates; instruments keep all, for they are lagged.
    """
    t = factors.time
    own = _dated(factors, design.factors, "factors").dropna()
    ins = _dated(instruments, design.instruments, "instruments").withColumnRenamed(instruments.time, t) if design.instruments and instruments else None
    if design.instruments and ins is None:
        raise ValueError("instruments need a dataset")
    bench = None
    if design.benchmarks:
        if benchmarks is None or design.benchmarks_excess and risk_free is None:
            raise ValueError("benchmarks need a dataset, and the risk-free rate where it is taken off")
        bench = _dated(benchmarks, design.benchmarks, "benchmarks").withColumnRenamed(benchmarks.time, t)
        bench = bench.select(t, *[(F.col(c) * design.scale).alias(c) for c in design.benchmarks])
        if design.benchmarks_excess:
            rates = align_risk_free(bench.select(t), risk_free, t).withColumnRenamed("rf", "_rf")
            bench = bench.join(rates, t).select(t, *[(F.col(c) - F.col("_rf")).alias(c) for c in design.benchmarks])
        bench = bench.dropna()
    return Series(t, own, bench, ins)


class Tables(Mapping):
    """Tables by name, each planned once and when it is first asked for: planning a regression reads the length of its longest series, that of differences joins all pairs of models."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __contains__(self, name: object) -> bool:
        return name in self._makers

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass(frozen=True)
class Analysis:
    """All tables of the factor section, by name; a table without its series is not there."""

    design: Design
    latent: tuple[str, ...]
    tables: Mapping[str, DataFrame] = field(default_factory=dict)


def analyse(daily: DataFrame, model: str, excess: str, design: Design, series: Series, latent: DataFrame | None = None) -> Analysis:
    """Every model's regressions: ``alpha``, ``latent_alpha``, ``timing``, ``spanning``, ``rolling``, ``cumulative``, and ``differences`` and ``joint`` across models.

    ``daily`` has a row a model and date, under the series' name of time; ``latent`` is a date-only frame of estimated factors. One job does
    all models of a table. Differences carry ``adjusted`` p-values. With one model there is no difference and no joint test worth its name.
    """
    t, d = series.time, design
    rows = daily.select(model, t, excess)
    on_factors = rows.join(F.broadcast(series.factors), t)  # a row a date, however many models

    def differences() -> DataFrame:
        found = st.alpha_difference(on_factors, model, t, excess, d.factors, d.lag)
        return found if d.correction == "none" else signals.adjust(found, "p_value", d.correction, order=["a", "b"])

    out = {
        "alpha": lambda: st.factor_alpha(on_factors, [model], t, excess, d.factors, d.periods, d.lag),
        "rolling": lambda: st.rolling_betas(on_factors, [model], t, excess, d.factors, d.window),
        "cumulative": lambda: st.cumulative_alpha(on_factors, [model], t, excess, d.factors),
        "differences": differences,
        "joint": lambda: st.joint_alpha_test(on_factors, [], model, t, excess, d.factors, d.lag),
    }
    if series.instruments is not None:
        others = [c for c in d.factors if c != d.market]
        out["timing"] = lambda: st.timing_model(on_factors, [model], t, excess, d.market, others, series.instruments, d.periods, d.instrument_lag, d.square, d.conditional_alpha, d.lag)
    if series.benchmarks is not None:
        out["spanning"] = lambda: st.spanning_test(rows.join(series.benchmarks, t), [model], t, excess, d.benchmarks, d.lag)
    names = tuple(c for c in latent.columns if c != t) if latent is not None else ()
    if names:
        out["latent_alpha"] = lambda: st.factor_alpha(rows.join(latent, t), [model], t, excess, names, d.periods, d.lag)
    return Analysis(d, names, Tables(out))


def factor_table(found: DataFrame, model: str, factors: Sequence[str], betas: str = "betas", p_values: str = "beta_p_values", alpha_p: str = "p_value") -> DataFrame:
    """``model, position, statistic, value, p_value``: annualised alpha, a row for each factor, and R squared, of every model in a table of regressions.

    A factor that a model's regression lacks is null; R squared has no p-value.
    """
    rows = [(0, "annualized_alpha", F.col("annualized_alpha"), F.col(alpha_p)), *[(i, c, F.try_element_at(F.col(betas), F.lit(c)), F.try_element_at(F.col(p_values), F.lit(c))) for i, c in enumerate(factors, 1)]]
    rows.append((len(factors) + 1, "r_squared", F.col("r_squared"), F.lit(None).cast("double")))
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("statistic"), v.alias("value"), p.alias("p_value")) for i, n, v, p in rows])
    return found.select(model, F.inline(cells))


def section(analysis: Analysis, model: str) -> Mapping[str, DataFrame]:
    """The factor tables of an analysis in long form, ready to be written: ``alpha``, ``latent_alpha``, ``timing`` and ``tests``."""
    d, t = analysis.design, analysis.tables

    def tests() -> DataFrame:
        joint = t["joint"].where("portfolios > 1").select(F.lit("all").alias("of"), F.lit("joint_zero_alpha").alias("test"), "statistic", "p_value")
        if "spanning" not in t:
            return joint
        return t["spanning"].select(F.col(model).cast("string").alias("of"), F.lit("spanning").alias("test"), "statistic", "p_value").unionByName(joint)

    out = {"alpha": lambda: factor_table(t["alpha"], model, d.factors), "tests": tests}
    if "latent_alpha" in t:
        out["latent_alpha"] = lambda: factor_table(t["latent_alpha"], model, analysis.latent)
    if "timing" in t:
        terms = [*(f"alpha_{c}" for c in d.instruments if d.conditional_alpha), d.market, *(f"{d.market}_x_{c}" for c in d.instruments), *(c for c in d.factors if c != d.market), *([f"{d.market}_squared"] if d.square else [])]
        out["timing"] = lambda: factor_table(t["timing"], model, terms, "coefficients", "p_values", "alpha_p_value")
    return Tables(out)
