"""The registry of features: each builds one column from a spec, over windows that all share an entity's order."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import finite, ratio
from ..panel import Panel

Builder = Callable[[Panel, Mapping], tuple[str, Column]]
REGISTRY: dict[str, tuple[Builder, tuple[str, ...]]] = {}


def feature(name: str, *columns: str) -> Callable[[Builder], Builder]:
    """Register a builder; ``columns`` are the spec's fields that name columns."""

    def register(build: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"feature {name} is registered already")
        REGISTRY[name] = build, columns
        return build

    return register


def lagged(p: Panel, x: Column, k: int, present: Column | None = None) -> Column:
    """``x`` of ``k`` rows ago; with ``present`` only rows where it holds count."""
    from pyspark.sql import Window

    if present is None:
        return F.lag(x, k).over(p.by_entity())
    w = Window.partitionBy(*([p.entity] if p.entity else []), present).orderBy(p.time)
    return F.when(present, F.lag(x, k).over(w))


def _series(spec: Mapping) -> Column:
    x = F.col(spec["column"])
    return x * F.col(spec["times"]) if spec.get("times") else x


def _present(x: Column, spec: Mapping) -> Column | None:
    return finite(x).isNotNull() if spec.get("skip_missing") else None


def log(x: Column) -> Column:
    """Natural logarithm; NULL unless positive."""
    return F.when(x > 0, F.ln(x))


def simple_change_of(p: Panel, spec: Mapping) -> Column:
    x = finite(_series(spec))
    return ratio(x, lagged(p, x, spec.get("horizon", 1), _present(x, spec))) - 1


@feature("log_change", "column", "times")
def _(p, s):
    x = finite(_series(s))
    return f"log_change_{s['column']}_{s.get('horizon', 1)}", log(x) - lagged(p, log(x), s.get("horizon", 1), _present(x, s))


@feature("simple_change", "column", "times")
def _(p, s):
    return f"simple_change_{s['column']}_{s.get('horizon', 1)}", simple_change_of(p, s)


@feature("positive_indicator", "column", "times")
def _(p, s):
    return f"positive_indicator_{s['column']}_{s.get('horizon', 1)}", (simple_change_of(p, s) > 0).cast("double")


@feature("log_difference", "left", "right")
def _(p, s):
    return f"log_difference_{s['left']}_{s['right']}", log(F.col(s["left"])) - lagged(p, log(F.col(s["right"])), 1)


@feature("simple_difference", "left", "right")
def _(p, s):
    return f"simple_difference_{s['left']}_{s['right']}", ratio(F.col(s["left"]), lagged(p, F.col(s["right"]), 1)) - 1


@feature("log_ratio", "numerator", "denominator")
def _(p, s):
    return f"log_ratio_{s['numerator']}_{s['denominator']}", log(F.col(s["numerator"])) - log(F.col(s["denominator"]))


@feature("simple_ratio", "numerator", "denominator")
def _(p, s):
    return f"simple_ratio_{s['numerator']}_{s['denominator']}", ratio(F.col(s["numerator"]), F.col(s["denominator"])) - 1


@feature("ratio", "numerator", "denominator")
def _(p, s):
    return f"ratio_{s['numerator']}_{s['denominator']}", ratio(F.col(s["numerator"]), F.col(s["denominator"]))


@feature("net_ratio", "add", "subtract", "denominator")
def _(p, s):
    net = sum((F.col(c) for c in s["add"]), F.lit(0.0)) - sum((F.col(c) for c in s.get("subtract", ())), F.lit(0.0))
    return f"net_ratio_{s['denominator']}", ratio(net, F.col(s["denominator"]))


@feature("range_location", "value", "high", "low")
def _(p, s):
    v, h, low = (F.col(s[k]) for k in ("value", "high", "low"))
    return f"range_location_{s['value']}", ratio(2 * v - h - low, h - low)


@feature("relative_spread", "upper", "lower")
def _(p, s):
    u, low = F.col(s["upper"]), F.col(s["lower"])
    return f"relative_spread_{s['upper']}_{s['lower']}", ratio(u - low, (u + low) / 2)


def _log_return(s: Mapping) -> Column:
    """Stands for the column that ``prepare`` adds: windows can't be nested."""
    return F.col(f"_lr_{s['column']}")


def _full(p: Panel, s: Mapping, x: Column, out: Column) -> Column:
    n = s["window"]
    return F.when(F.count(x).over(p.trailing(n)) >= s.get("min_periods", n), out)


@feature("rolling_volatility", "column")
def _(p, s):
    r = _log_return(s)
    return f"rolling_volatility_{s['column']}_{s['window']}", _full(p, s, r, F.stddev_samp(r).over(p.trailing(s["window"])))


@feature("downside_deviation", "column")
def _(p, s):
    r = _log_return(s)
    low = F.pow(F.least(r, F.when(r.isNotNull(), 0.0)), 2)
    return f"downside_deviation_{s['column']}_{s['window']}", _full(p, s, r, F.sqrt(F.avg(low).over(p.trailing(s["window"]))))


@feature("rolling_skewness", "column")
def _(p, s):
    r = _log_return(s)
    return f"rolling_skewness_{s['column']}_{s['window']}", _full(p, s, r, F.skewness(r).over(p.trailing(s["window"])))


@feature("high_proximity", "value", "high")
def _(p, s):
    h = F.col(s["high"])
    top = F.max(h).over(p.trailing(s["window"]))
    return f"high_proximity_{s['value']}_{s['window']}", _full(p, s, h, F.when(top > 0, ratio(F.col(s["value"]), top)))


@feature("amihud_illiquidity", "column", "volume")
def _(p, s):
    r, traded = _log_return(s), F.col(s["column"]) * F.col(s["volume"])
    each = F.when(traded > 0, ratio(F.abs(r), traded))
    mean = _full(p, s, each, F.avg(each).over(p.trailing(s["window"])))
    return f"amihud_illiquidity_{s['column']}_{s['window']}", log(mean) if s.get("log") else mean


@feature("passthrough", "column")
def _(p, s):
    return s["column"], F.col(s["column"])


@feature("cross_sectional_median", "column")
def _(p, s):
    """A label that looks ahead: is the forward log return above the date's median?"""
    forward = F.col(f"_fwd_{s['column']}_{s['horizon']}")
    return f"cross_sectional_median_{s['column']}_{s['horizon']}", F.when(forward.isNotNull(), (forward > F.median(forward).over(p.by_time())).cast("double"))


def prepare(p: Panel, specs: Sequence[Mapping]) -> Panel:
    """Columns that several features or their windows build on, each computed once."""
    returns = {s["column"] for s in specs if s["op"] in ("rolling_volatility", "downside_deviation", "rolling_skewness", "amihud_illiquidity")}
    new = {f"_lr_{c}": log(F.col(c)) - lagged(p, log(F.col(c)), 1) for c in sorted(returns)}
    for s in specs:
        if s["op"] == "cross_sectional_median":
            x = log(F.col(s["column"]))
            new[f"_fwd_{s['column']}_{s['horizon']}"] = F.lead(x, s["horizon"]).over(p.by_entity()) - x
    return p.with_df(p.df.withColumns(new)) if new else p


def build_features(p: Panel, specs: Sequence[Mapping]) -> Panel:
    """The panel's keys and one column for each spec (``op``, its fields, ``as``, ``shift``).

    ``shift`` moves a finished feature ``k`` rows back in time (negative: ahead) inside the entity. Names may not repeat.
    """
    for s in specs:
        if s["op"] not in REGISTRY:
            raise KeyError(f"unknown feature {s['op']}")
        for field in REGISTRY[s["op"]][1]:
            value = s.get(field)
            p.require(*([value] if isinstance(value, str) else value or []))
    q, names, new = prepare(p, specs), [], {}
    for s in specs:
        default, column = REGISTRY[s["op"]][0](q, s)
        name = s.get("as", default)
        if name in new or name in p.keys:
            raise ValueError(f"two features are called {name}")
        new[name] = column
        names.append(name)
    df = q.df.select(*p.keys, *[c.alias(n) for n, c in new.items()])
    shifts = {s.get("as", n): s["shift"] for n, s in zip(names, specs, strict=True) if s.get("shift")}
    if shifts:
        w = p.by_entity()
        df = df.withColumns({n: F.lag(n, k).over(w) if k > 0 else F.lead(n, -k).over(w) for n, k in shifts.items()})
    return p.with_df(df)
