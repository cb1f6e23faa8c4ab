"""What a result was made from and by: counted and digested in the same pass that writes it."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import sys
import time
import uuid
from collections.abc import Mapping
from importlib import metadata

import quantloom
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .store import Files, canonical

LAYOUT = 1
#: What the session of a write takes over.
SETTINGS = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions")


def code_digest() -> str:
    """Of all source files of the package, in order of their names."""
    root, h = os.path.dirname(os.path.abspath(quantloom.__file__)), hashlib.sha256()
    names = sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if f.endswith(".py"))
    for name in names:
        with open(os.path.join(root, name), "rb") as f:
            h.update(name.replace(os.sep, "/").encode() + b"\0" + hashlib.sha256(f.read()).digest())
    return h.hexdigest()


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions that a result may hang on, and the session's settings of the SQL engine."""
    found = {"python": platform.python_version(), "spark": spark.version, "java": spark._jvm.System.getProperty("java.version"), "time_zone": spark.conf.get("spark.sql.session.timeZone")}
    for name in ("pyspark", "pyarrow", "numpy", "pandas"):
        try:
            found[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            found[name] = getattr(sys.modules.get(name), "__version__", "")
    return found | {"ansi": spark.conf.get("spark.sql.ansi.enabled")}


def plan_digest(df: DataFrame) -> str:
    """Of the analysed plan with its expression ids in order of appearance: equal for the same query built again, in any session."""
    import re

    ids: dict[str, str] = {}
    text = df._jdf.queryExecution().analyzed().toString()
    return hashlib.sha256(re.sub(r"#\d+", lambda m: ids.setdefault(m[0], f"#{len(ids)}"), text).encode()).hexdigest()


def _measures(df: DataFrame) -> list:
    columns = [f"`{c.replace('`', '``')}`" for c in df.columns]
    hashed = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")
    return [F.count(F.lit(1)).alias("rows"), hashed.alias("sum_hash"), *[F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(columns)]]


def write_table(df: DataFrame, path: str) -> dict:
    """Write Parquet and return what was written: rows, digest, nulls by column, schema and plan. The rows are observed as they pass, never read again.

    The write runs in a session of its own with the same settings: one that has observed anything can't be sent to tasks any more, as models of
    Spark's own library do.
    """
    spark, name, seen = df.sparkSession, f"observed_{uuid.uuid4().hex}", Observation()
    own = spark.newSession()
    for key in SETTINGS:
        own.conf.set(key, spark.conf.get(key))
    df.createGlobalTempView(name)
    try:
        own.table(f"global_temp.{name}").observe(seen, *_measures(df)).write.parquet(path)
        found = seen.get
    finally:
        spark.catalog.dropGlobalTempView(name)
    return {"rows": found["rows"], "sum_hash": found["sum_hash"], "nulls": {c: found[f"null_{i}"] for i, c in enumerate(df.columns)}, "schema": df.schema.simpleString(), "plan": plan_digest(df)}


def write_analytics(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], settings: object = None, sources: Mapping[str, str] | None = None) -> dict:
    """All tables of an analysis below ``root``, a new folder, and last its manifest: whoever sees that sees all of them.

    The manifest has each table's facts, the settings in plain form, the sources' digests, the code's and the environment.
    """
    files = Files(spark, root)
    if files.listed():
        raise FileExistsError(f"{root} isn't empty")
    if not tables or any("/" in n or n.startswith(("_", ".")) for n in tables):
        raise ValueError("tables need plain names")
    written = {n: write_table(df, f"{files.root}/{n}") for n, df in tables.items()}
    body = {"layout": LAYOUT, "tables": written, "settings": canonical(settings), "sources": dict(sorted((sources or {}).items())), "code": code_digest(), "environment": environment(spark)}
    body["digest"] = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
    files.write("_analytics.json", json.dumps(body | {"written_at": time.time()}, indent=1).encode())
    return body


def read_analytics(spark: SparkSession, root: str, check: bool = False) -> tuple[dict, dict[str, DataFrame]]:
    """(manifest, tables); ``check`` reads the tables and compares rows and digests. A manifest that was changed is an error."""
    raw = Files(spark, root).read("_analytics.json")
    if raw is None:
        raise FileNotFoundError(f"{root} has no manifest")
    body = json.loads(raw)
    body.pop("written_at")
    if hashlib.sha256(json.dumps({k: v for k, v in body.items() if k != "digest"}, sort_keys=True).encode()).hexdigest() != body["digest"]:
        raise ValueError(f"the manifest of {root} was changed")
    tables = {n: spark.read.parquet(f"{root}/{n}") for n in body["tables"]}
    if check:
        for n, df in tables.items():
            found = df.agg(*_measures(df)[:2]).first()
            if (found.rows, found.sum_hash) != (body["tables"][n]["rows"], body["tables"][n]["sum_hash"]):
                raise ValueError(f"{n} isn't what was written")
    return body, tables
