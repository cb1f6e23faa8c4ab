"""Folds run phase by phase, with a ledger that survives the driver.

Every phase's tables go to a store below the run's folder before the next begins, so a run that was killed goes on at the
phase it was in. A run belongs to what it was begun with: another plan, other sources or other code are refused. One
driver at a time may own a run.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal
from ..sources.store import Files, Store, canonical, inside, key_of

Tables = Mapping[str, DataFrame]
#: (name, what makes its tables from the fold's row and all tables of earlier phases, as ``phase.table``)
Phase = tuple[str, Callable[[Mapping, Tables], Tables]]


class RunError(RuntimeError):
    """A run can't be opened or gone on with."""


def differences(a: object, b: object, at: str = "") -> list[str]:
    """Paths at which two plain values differ."""
    if isinstance(a, Mapping) and isinstance(b, Mapping):
        return [x for k in sorted({*a, *b}, key=str) for x in differences(a.get(k), b.get(k), f"{at}.{k}" if at else str(k))]
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        return [x for i, (u, v) in enumerate(zip(a, b, strict=True)) for x in differences(u, v, f"{at}[{i}]")]
    return [] if a == b else [at or "all of it"]


@dataclass
class Run:
    """A run's folder below ``root``: contract, lock, ledger and phases. Use as a context, which takes and gives back the lock."""

    spark: SparkSession
    root: str
    name: str
    plan: object
    sources: Mapping[str, str] = field(default_factory=dict)
    code: str = ""
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        if "/" in inside(self.name):
            raise ValueError("a run's name is one part of a path")
        self.files = Files(self.spark, f"{self.root}/{self.name}")
        self.store = Store(self.spark, f"{self.files.root}/phases")
        self.contract = {"plan": canonical(self.plan), "sources": dict(sorted(self.sources.items())), "code": self.code}

    # the lock

    def __enter__(self) -> Run:
        self.acquire()
        try:
            self._check_contract()
        except BaseException:
            self.release()
            raise
        return self

    def __exit__(self, *_: object) -> None:
        self.release()

    def holder(self) -> str | None:
        raw = self.files.read("lock")
        return raw.decode() if raw is not None else None

    def acquire(self, instead_of: str | None = None) -> None:
        """Own the run. ``instead_of`` names an owner known to be dead, whose lock is moved aside first; if another holds it by now, that fails.

        The lock is a file that can only be made where there is none, which every file system of Spark's decides for one of two.
        """
        if instead_of is not None:
            if self.holder() != instead_of:
                raise RunError(f"{self.name} is held by {self.holder()}, not by {instead_of}")
            aside = f"lock-of-{instead_of}-{uuid.uuid4().hex}"
            if not self.files.rename("lock", aside) or self.files.read(aside) != instead_of.encode():
                raise RunError(f"the lock of {self.name} changed hands meanwhile")
        try:
            self.files.write("lock", self.owner.encode())
        except Exception as e:
            raise RunError(f"{self.name} is held by {self.holder()}") from e
        if self.holder() != self.owner:
            raise RunError(f"{self.name} is held by {self.holder()}")

    def release(self) -> None:
        if self.holder() == self.owner:
            self.files.delete("lock")

    # contract and ledger

    def _check_contract(self) -> None:
        raw = self.files.read("contract.json")
        if raw is None:
            self.files.write("contract.json", json.dumps(self.contract).encode())
        elif odd := differences(json.loads(raw), self.contract):
            raise RunError(f"{self.name} was begun with something else: {odd[:10]}")

    def record(self, event: str, **facts: object) -> None:
        """A file an event: what is written once is never written again."""
        entry = {"event": event, "owner": self.owner, "at": time.time(), **facts}
        self.files.write(f"ledger/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json", json.dumps(entry).encode())

    def ledger(self) -> list[dict]:
        """All events in order of time."""
        return [json.loads(self.files.read(n)) for n in sorted(self.files.listed("ledger"))]

    # phases

    def phase(self, fold: int, name: str, make: Callable[[], Tables]) -> dict[str, DataFrame]:
        """The tables of a phase: from the store if it was ended before, else made, stored and recorded."""
        if self.holder() != self.owner:
            raise RunError(f"{self.name} is held by {self.holder()}")
        key = key_of([fold, name], {}, "phase")
        found = self.store.get(key)
        if found is not None:
            self.record("reused", fold=fold, phase=name)
            return found
        self.record("began", fold=fold, phase=name)
        try:
            tables = self.store.put(key, make())
        except BaseException as e:
            self.record("failed", fold=fold, phase=name, error=f"{type(e).__name__}: {e}"[:500])
            raise
        self.record("ended", fold=fold, phase=name, rows={n: df.count() for n, df in tables.items()})
        return tables

    def execute(self, folds: DataFrame, phases: Sequence[Phase]) -> dict[int, dict[str, DataFrame]]:
        """Run every phase of every fold, oldest fold first; what is there already is read. Returns each fold's tables, as ``phase.table``."""
        names = [n for n, _ in phases]
        if not names or len(set(names)) < len(names):
            raise ValueError("phases need names of their own")
        out = {}
        for row in folds.orderBy("fold").collect():  # a row a fold
            have: dict[str, DataFrame] = {}
            for name, make in phases:
                found = self.phase(int(row.fold), name, lambda make=make, have=have, row=row: make(row.asDict(), dict(have)))
                have |= {f"{name}.{t}": df for t, df in found.items()}
            out[int(row.fold)] = have
        return out


def status(ledger: Sequence[Mapping]) -> dict[tuple[int, str], str]:
    """The last event of each phase of each fold."""
    return {(e["fold"], e["phase"]): e["event"] for e in ledger if "phase" in e}


def interrupted(spark: SparkSession, root: str) -> list[str]:
    """Runs below ``root`` of which a phase began or failed and hasn't ended since."""
    files = Files(spark, root)
    names = sorted({n.split("/")[0] for n in files.listed() if n.endswith("/contract.json")})
    return [n for n in names if set(status(Run(spark, root, n, None).ledger()).values()) & {"began", "failed"}]


def to_resume(spark: SparkSession, root: str, name: str | None = None) -> str | None:
    """The run to go on with: ``name`` if it was interrupted, or the only interrupted one; None without any, an error with several."""
    found = interrupted(spark, root)
    if name is not None:
        if name not in found:
            raise RunError(f"{name} has nothing to go on with")
        return name
    if len(found) > 1:
        raise RunError(f"several runs were interrupted: {found}")
    return found[0] if found else None


def fold_parts(panel: DataFrame, time_column: str, fold: Mapping) -> dict[str, DataFrame]:
    """A fold's training, validation and test rows."""
    return {p: panel.where(F.col(time_column).between(F.lit(fold[f"{p}_start"]), F.lit(fold[f"{p}_end"]))) for p in ("train", "val", "test")}


def walk_forward(run: Run, panel: DataFrame, time_column: str, splitter: temporal.Splitter, fit: Callable[[Tables], Tables], predict: Callable[[Tables], Tables], evaluate: Callable[[Tables], Tables]) -> dict[int, dict[str, DataFrame]]:
    """The four phases of every fold of a split: ``prepare`` its rows, ``fit``, ``predict``, ``evaluate``."""
    folds = temporal.folds(panel, time_column, splitter)
    return run.execute(folds, [("prepare", lambda fold, _: fold_parts(panel, time_column, fold)), ("fit", lambda _, t: fit(t)), ("predict", lambda _, t: predict(t)), ("evaluate", lambda _, t: evaluate(t))])
