"""A declarative plan: datasets, cleaning steps, features, alignment and split as one mapping, checked as a whole before any scan.

``sources`` name files and columns, ``steps`` and ``features`` are ordered lists for each dataset, ``primary`` is the
dataset whose rows are the grid, ``spells`` its pairs of activity bounds. ``validate`` reports every mistake at once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..operators import align, clean, features, temporal
from ..panel import Panel
from ..sources import View, load
from ..sources.store import Store, key_of, listing_digest

KINDS = ("panel", "context", "events", "table")


@dataclass
class Plan:
    sources: Mapping[str, View]
    primary: str
    steps: Mapping[str, Sequence[tuple[str, dict]]] = field(default_factory=dict)
    features: Mapping[str, Sequence[Mapping]] = field(default_factory=dict)
    spells: Sequence[tuple[str, str]] = ()
    split: temporal.Splitter | None = None
    kinds: Mapping[str, str] = field(default_factory=dict)
    label_shift: int = 0
    #: Returns that a portfolio earns carry ``-realisation_lag`` as their shift; None: not checked.
    realised: Mapping[str, Sequence[str]] = field(default_factory=dict)
    realisation_lag: int | None = None


def validate(plan: Plan) -> list[str]:
    """All mistakes; an empty list means that the plan can run."""
    out = []
    if plan.primary not in plan.sources:
        out.append(f"primary dataset {plan.primary} is no source")
    for name in {*plan.steps, *plan.features, *plan.kinds} - set(plan.sources):
        out.append(f"{name} is no source")
    out += [f"{n}: unknown kind {k}" for n, k in plan.kinds.items() if k not in KINDS]
    out += [f"{n}: unknown step {s}" for n, steps in plan.steps.items() for s, _ in steps if s not in clean.STEPS]
    for name, steps in plan.steps.items():
        for step, options in steps:
            t = options.get("threshold")
            if step == "missing_threshold_filter" and (t is None or not 0 <= t < 1):
                out.append(f"{name}: threshold must lie in [0, 1)")
    for name, specs in plan.features.items():
        seen = set()
        for s in specs:
            if s.get("op") not in features.REGISTRY:
                out.append(f"{name}: unknown feature {s.get('op')}")
            if s.get("as") in seen:
                out.append(f"{name}: two features are called {s['as']}")
            seen |= {s["as"]} if "as" in s else set()
            if s.get("window", 1) < 1 or s.get("horizon", 1) < 1:
                out.append(f"{name}: windows and horizons are at least 1")
        out += shift_errors(name, specs, plan.realised.get(name, ()), plan.realisation_lag)
    if plan.split:
        try:
            temporal.check_purge(plan.split.purge, plan.label_shift)
        except ValueError as e:
            out.append(str(e))
    return sorted(out)


def shift_errors(name: str, specs: Sequence[Mapping], realised: Sequence[str], lag: int | None) -> list[str]:
    """A realised return must look ahead by exactly the lag between decision and outcome."""
    if lag is None:
        return []
    shifts = {s.get("as"): s.get("shift", 0) for s in specs}
    return [f"{name}: {c} must have shift {-lag}" for c in realised if shifts.get(c) != -lag]


def required_history(specs: Sequence[Mapping]) -> int:
    """Rows before the first that the features look back on."""
    return max((s.get("window", 1) - 1 + s.get("horizon", 1) + max(s.get("shift", 0), 0) for s in specs), default=0)


def cache_key(plan: Plan, digests: Mapping[str, str]) -> str:
    """Changes with the plan and with the contents of its files."""
    return hashlib.sha256(json.dumps([repr(plan), sorted(digests.items())]).encode()).hexdigest()


def run(spark: SparkSession, plan: Plan) -> Panel:
    """The aligned panel as one lazy plan: load, clean, features, alignment. Unused sources are never opened."""
    errors = validate(plan)
    if errors:
        raise ValueError("; ".join(errors))
    used = [n for n in plan.sources if n == plan.primary or n in plan.features]
    panels = {n: clean.apply_steps(p, plan.steps.get(n, ())) for n, p in load(spark, {n: plan.sources[n] for n in used}).items()}
    if any(p.extra_keys for p in panels.values()):
        raise ValueError("event-keyed datasets can't be aligned")
    built = [features.build_features(panels[n], plan.features[n]) for n in used if n in plan.features]
    return align.align_and_mask(panels[plan.primary], built, plan.spells)


def prepared(spark: SparkSession, plan: Plan, store: Store, digests: Mapping[str, str] | None = None, code: str = "") -> tuple[Panel, bool]:
    """(the aligned panel, whether the store had it). Where it had, no source is opened.

    ``digests`` name the contents of the sources, by source; without them the files' names, lengths and times do.
    """
    errors = validate(plan)
    if errors:
        raise ValueError("; ".join(errors))
    known = digests if digests is not None else {n: listing_digest(spark, v.path) for n, v in plan.sources.items()}
    key, made = key_of(plan, known, code), {}

    def make() -> dict:
        made["panel"] = run(spark, plan)
        return {"panel": made["panel"].df}

    tables, hit = store.get_or_make(key, make)
    primary = plan.sources[plan.primary]
    panel = made.get("panel") or Panel(tables["panel"], time=primary.time[0], entity=primary.entity[0] if primary.entity else None)
    return panel.with_df(tables["panel"]), hit


def parts(panel: Panel, plan: Plan) -> Panel:
    """The panel's rows with ``fold`` and ``part`` of the plan's split."""
    return panel.with_df(temporal.assign(panel.df, panel.time, temporal.folds(panel.df, panel.time, plan.split)))
