"""What has to be read, worked out before anything is: one column set and one filter on entities for each file.

Models and analyses say which columns of which datasets they need. Features lead from those to columns of sources, cleaning
steps add what they look at, and what nobody needs is never opened.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from ..operators import features
from ..sources import ColumnSpec, View
from .spec import Plan, required_history


@dataclass(frozen=True)
class Need:
    """Columns of a dataset (None: all of its features), for some entities (None: all that the dataset has)."""

    dataset: str
    columns: tuple[str, ...] | None = None
    entities: tuple | None = None


def model_needs(inputs: Mapping) -> list[Need]:
    """Of a model: its ``features`` dataset and ``context`` ones whole, and single columns for ``supervision``, ``classification`` and ``risk_free``.

    A ``target`` makes all but context and risk-free rates needed for that entity alone; ``universe`` for those of a list; both is an error.
    """
    if odd := sorted(set(inputs) - {"features", "context", "supervision", "classification", "risk_free", "target", "universe"}):
        raise ValueError(f"unknown inputs {odd}")
    if "target" in inputs and "universe" in inputs:
        raise ValueError("a model has one target or a universe")
    scope = (inputs["target"],) if "target" in inputs else tuple(inputs["universe"]) if "universe" in inputs else None
    out = [Need(inputs["features"], None, scope), *(Need(c) for c in inputs.get("context", ()))]
    out += [Need(dataset, (column,), scope) for dataset, column in (inputs[k] for k in ("supervision", "classification") if k in inputs)]
    return out + ([Need(inputs["risk_free"][0], (inputs["risk_free"][1],))] if "risk_free" in inputs else [])


def analytics_needs(risk_free: tuple[str, str], factors: tuple[str, Sequence[str]] | None = None, benchmarks: tuple[str, Sequence[str]] | None = None, instruments: tuple[str, Sequence[str]] | None = None, latent: Mapping | None = None) -> tuple[list[Need], str]:
    """(needs, view) of an analysis: the risk-free rate always, factor series where there are any.

    ``latent`` (``aligning``, ``returns`` as dataset and column, ``characteristics``) needs whole panels and turns the view from ``features``
    to ``aligned``, for only there stand ages and what was carried.
    """
    out = [Need(risk_free[0], (risk_free[1],)), *(Need(d, tuple(c)) for d, c in filter(None, (factors, benchmarks, instruments)))]
    if latent is None:
        return out, "features"
    return [*out, Need(latent["aligning"]), Need(latent["returns"][0], (latent["returns"][1],)), Need(latent["characteristics"])], "aligned"


@dataclass(frozen=True)
class Reading:
    """A dataset's part of a file: the view to load, the features to build on it, and rows to look back on."""

    view: View
    features: tuple[Mapping, ...]
    history: int


def _named(x: object) -> Iterable[str]:
    """All words in the options of a step: a column that one may look at is read."""
    if isinstance(x, str):
        yield x
    elif isinstance(x, Mapping):
        for k, v in x.items():
            yield from _named(k)
            yield from _named(v)
    elif isinstance(x, Iterable):
        for v in x:
            yield from _named(v)
    elif hasattr(x, "__dataclass_fields__"):
        for n in x.__dataclass_fields__:
            yield from _named(getattr(x, n))


def _feature_names(specs: Sequence[Mapping]) -> list[str]:
    if unnamed := [s for s in specs if "as" not in s]:
        raise ValueError(f"features need names to be asked for: {unnamed[:3]}")
    return [s["as"] for s in specs]


def close(plan: Plan, needs: Iterable[Need]) -> dict[str, Reading]:
    """What to read of each dataset that anybody needs, with the primary one. Unknown datasets, columns and excluded entities are errors, all told at once."""
    merged: dict[str, list[Need]] = {}
    for n in [Need(plan.primary, ()), *needs]:
        merged.setdefault(n.dataset, []).append(n)
    out, odd = {}, []
    for name, own in merged.items():
        view = plan.sources.get(name)
        if view is None:
            odd.append(f"no dataset {name}")
            continue
        specs = list(plan.features.get(name, ()))
        asked = None if any(n.columns is None for n in own) else {c for n in own for c in n.columns or ()}
        built = set(_feature_names(specs)) if specs else set()
        offered = built or set(view.columns)
        if asked is not None and (wrong := sorted(asked - offered)) and not (view.all_columns and not specs):
            odd.append(f"{name} has no {wrong}")
        kept = [s for s in specs if asked is None or s["as"] in asked]
        used = {c for s in kept for f in features.REGISTRY[s["op"]][1] for c in ([s[f]] if isinstance(s.get(f), str) else s.get(f) or [])}
        used |= set() if specs else (set(view.columns) if asked is None else set(asked))
        used |= {w for _, options in plan.steps.get(name, ()) for w in _named(options)}
        used |= {w for pair in plan.spells for w in pair} if name == plan.primary else set()
        # the primary's scope is what the others need of it: its own rows are the grid
        scopes = [n.entities for n in (own[1:] or own if name == plan.primary else own)]
        wanted = None if any(s is None for s in scopes) else tuple(dict.fromkeys(e for s in scopes for e in s))
        named = dict.fromkeys(e for n in own for e in n.entities or ())
        if view.entity and view.entities is not None and (gone := [e for e in named if e not in view.entities]):
            odd.append(f"{name} leaves out {gone}")
        entities = view.entities if wanted is None or not view.entity else wanted
        columns = {c: s for c, s in view.columns.items() if c in used}
        whole = view.all_columns
        if whole and (asked is not None or specs):
            # of a wildcard only what is used, under its own name or the one it was given
            back = {v: k for k, v in view.rename.items()}
            columns |= {c: ColumnSpec(back.get(c, c)) for c in sorted(used - set(columns)) if back.get(c, c) not in view.exclude and c in used & _wildcard(specs, asked)}
            whole = False
        out[name] = Reading(replace(view, columns=columns, all_columns=whole, entities=entities), tuple(kept), required_history(kept))
    if odd:
        raise ValueError("; ".join(sorted(odd)))
    return out


def _wildcard(specs: Sequence[Mapping], asked: set | None) -> set[str]:
    """Columns that can only come from a wildcard: the inputs of features, or what is asked for without any."""
    fed = {c for s in specs for f in features.REGISTRY[s["op"]][1] for c in ([s[f]] if isinstance(s.get(f), str) else s.get(f) or [])}
    return fed if specs else set(asked or ())


def files(readings: Mapping[str, Reading]) -> dict[str, set[str]]:
    """The source columns of each file that will be scanned; a wildcard is ``*``."""
    out: dict[str, set[str]] = {}
    for r in readings.values():
        v = r.view
        own = out.setdefault(v.path, set())
        own |= {s.source for _, s in [v.time, *([v.entity] if v.entity else []), *v.columns.items()]} | ({"*"} if v.all_columns else set())
    return out


def narrowed(plan: Plan, needs: Iterable[Need]) -> Plan:
    """The same plan with only what is needed: sources, columns, entities and features."""
    found = close(plan, needs)
    return replace(plan, sources={n: r.view for n, r in found.items()}, steps={n: s for n, s in plan.steps.items() if n in found}, features={n: r.features for n, r in found.items() if r.features}, kinds={n: k for n, k in plan.kinds.items() if n in found}, realised={n: c for n, c in plan.realised.items() if n in found})
