"""CSV and Parquet readers with canonical names, checks before the scan, fingerprints, and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import number
from ..panel import Panel


@dataclass(frozen=True)
class ColumnSpec:
    """``source`` column, and its kind: ``number``, ``date`` or a Spark type's name."""

    source: str
    kind: str = "number"
    date_format: str | None = None


@dataclass(frozen=True)
class View:
    """A logical dataset over a file: canonical names, key roles, and which entities it wants."""

    path: str
    time: tuple[str, ColumnSpec]
    entity: tuple[str, ColumnSpec] | None = None
    columns: Mapping[str, ColumnSpec] = field(default_factory=dict)
    #: Load every other column too, as numbers, but for ``exclude``, under names from ``rename``.
    all_columns: bool = False
    exclude: tuple[str, ...] = ()
    rename: Mapping[str, str] = field(default_factory=dict)
    entities: tuple | None = None


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).limit(0).columns


def resolve(view: View, names: list[str]) -> dict[str, ColumnSpec]:
    """Canonical name to column, in order: time, entity, explicit columns, then the rest where asked for."""
    out = dict([view.time])
    if view.entity:
        out[view.entity[0]] = view.entity[1]
    out.update(view.columns)
    if view.all_columns:
        used = {c.source for c in out.values()} | set(view.exclude)
        out |= {view.rename.get(n, n): ColumnSpec(n) for n in names if n not in used and view.rename.get(n, n) not in out}
    missing = sorted({c.source for c in out.values()} - set(names))
    if missing:
        raise KeyError(f"{view.path} has no columns {missing}")
    return out


def check_kinds(layouts: Iterable[Mapping[str, ColumnSpec]]) -> None:
    """Views of one file may not give a column different kinds."""
    kinds: dict[str, str] = {}
    for layout in layouts:
        for c in layout.values():
            if kinds.setdefault(c.source, c.kind) != c.kind:
                raise TypeError(f"column {c.source} is wanted as {kinds[c.source]} and as {c.kind}")


def typed(c: ColumnSpec):
    """Numbers that don't parse are NULL; dates that don't parse raise."""
    raw = F.col(f"`{c.source}`")
    if c.kind == "number":
        return number(raw)
    if c.kind == "date":
        return F.to_timestamp(raw, c.date_format) if c.date_format else raw.cast("timestamp")
    return raw.cast(c.kind)


def load(spark: SparkSession, views: Mapping[str, View]) -> dict[str, Panel]:
    """Panels by name. Views of one file share one scan's definition; each prunes its own columns and rows."""
    bases: dict[str, DataFrame] = {}
    layouts = {}
    for name, view in views.items():
        if view.path not in bases:
            names = header(spark, view.path)
            bases[view.path] = spark.read.schema(StructType([StructField(n, StringType()) for n in names])).option("header", True).option("nullValue", "").csv(view.path)
        layouts[name] = resolve(view, bases[view.path].columns)
    for path in bases:
        check_kinds(layouts[n] for n, v in views.items() if v.path == path)
    out = {}
    for name, view in views.items():
        df = bases[view.path].select(*[typed(c).alias(n) for n, c in layouts[name].items()])
        if view.entity and view.entities is not None:
            df = df.where(F.col(view.entity[0]).isin(*view.entities))
        out[name] = Panel(df, view.time[0], view.entity[0] if view.entity else None)
    return out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fingerprint(df: DataFrame) -> DataFrame:
    """``rows, sum_hash, schema``: equal for equal rows in any order."""
    cols = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).cast("string").alias("sum_hash")).withColumn("schema", F.lit(df.schema.simpleString()))


def export(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a result; small reports as one CSV or JSON file, large tables as Parquet."""
    out = df.coalesce(1) if kind in ("csv", "json") else df
    writer = out.write.mode(mode)
    (writer.option("header", True).csv if kind == "csv" else getattr(writer, kind))(path)
