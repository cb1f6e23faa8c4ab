"""Manifests of source files, and a store of prepared tables under the key of what they were made from.

Files are listed and renamed by the file system that Spark uses, so any of its stores will do. A digest reads a file from
begin to end inside one task, in pieces; no value ever holds a file.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from .tables import fingerprint

#: Bytes that a digest reads at a time.
PIECE = 8 << 20
MANIFEST = "_manifest.json"
#: Entries of another layout are no entries.
LAYOUT = 1


class Files:
    """The file system of a folder, as Spark's JVM sees it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.jvm = spark, spark._jvm
        path = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(path).toString().rstrip("/")

    def path(self, name: str = "") -> object:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{inside(name)}" if name else self.root)

    def listed(self, name: str = "") -> dict[str, tuple[int, int]]:
        """Length and time of change of every file below, by its path from the root."""
        out, at = {}, self.path(name)
        if not self.fs.exists(at):
            return out
        files = self.fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            out[f.getPath().toString().removeprefix(self.root + "/")] = (f.getLen(), f.getModificationTime())
        return out

    def read(self, name: str) -> bytes | None:
        at = self.path(name)
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, content: bytes) -> None:
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()

    def rename(self, a: str, b: str) -> bool:
        """Whether ``a`` is now ``b``; never onto or into something that is there."""
        return not self.fs.exists(self.path(b)) and self.fs.rename(self.path(a), self.path(b))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def inside(name: str) -> str:
    """A path below the root, or an error."""
    plain = posixpath.normpath(name)
    if name.startswith("/") or "://" in name or plain == ".." or plain.startswith("../") or "\\" in name:
        raise ValueError(f"{name} leads out of the folder")
    return plain


def digests(spark: SparkSession, root: str, names: list[str] | None = None, piece: int = PIECE) -> DataFrame:
    """``name, length, sha256`` of the files below ``root``, or of ``names``; a task reads a file in pieces of ``piece`` bytes.

    A file that can't be read has a null digest. An empty folder gives no row. Tasks open files by PyArrow, which has to know the store.
    """
    files = Files(spark, root)
    found = files.listed()
    wanted = sorted(found) if names is None else [inside(n) for n in names]
    base = files.root

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = urlparse(base)
        for batch in batches:
            names, lengths, hashes = batch.column("name").to_pylist(), [], []
            for name in names:
                h, n = hashlib.sha256(), 0
                try:
                    if parsed.scheme in ("", "file"):
                        fs, at = pa.fs.LocalFileSystem(), f"{unquote(parsed.path)}/{name}"
                    else:
                        fs, at = pa.fs.FileSystem.from_uri(f"{base}/{name}")
                    with fs.open_input_stream(at, buffer_size=0) as stream:
                        while part := stream.read(piece):
                            h.update(part)
                            n += len(part)
                    lengths.append(n)
                    hashes.append(h.hexdigest())
                except OSError:
                    lengths.append(None)
                    hashes.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(lengths, pa.int64()), pa.array(hashes, pa.string())], ["name", "length", "sha256"])

    rows = spark.createDataFrame([(n,) for n in wanted], "name string")
    # a file a task, as far as there are tasks: files differ in size
    return rows.repartition(max(1, min(len(wanted), 10_000)), "name").mapInArrow(read, "name string, length bigint, sha256 string")


def write_manifest(spark: SparkSession, root: str, target: str) -> dict[str, tuple[int, str]]:
    """Digest every file below ``root`` and write the list to ``target``, a new JSON file. A file that can't be read is an error."""
    found = {r.name: (r.length, r.sha256) for r in digests(spark, root).collect()}
    if odd := sorted(n for n, (_, h) in found.items() if h is None):
        raise OSError(f"can't read {odd[:5]}")
    folder, _, name = target.rpartition("/")
    Files(spark, folder).write(name, json.dumps({"layout": LAYOUT, "files": {n: list(v) for n, v in sorted(found.items())}}, indent=1).encode())
    return found


def read_manifest(spark: SparkSession, target: str) -> dict[str, tuple[int, str]]:
    """Length and digest by name; names that lead out of the folder, and digests that are none, are errors."""
    folder, _, name = target.rpartition("/")
    raw = Files(spark, folder).read(name)
    if raw is None:
        raise FileNotFoundError(target)
    content = json.loads(raw)
    if content.get("layout") != LAYOUT:
        raise ValueError(f"{target} has another layout")
    out = {}
    for n, (length, digest) in content["files"].items():
        if inside(n) != n or not isinstance(length, int) or length < 0 or len(digest) != 64 or set(digest) - set("0123456789abcdef"):
            raise ValueError(f"{target}: {n} is no entry")
        out[n] = (length, digest)
    return out


def drift(spark: SparkSession, root: str, manifest: Mapping[str, tuple[int, str]]) -> dict[str, str]:
    """What differs from a manifest: ``missing``, ``added`` or ``changed`` by name. Only files of the right length are read."""
    here = Files(spark, root).listed()
    out = dict.fromkeys(set(manifest) - set(here), "missing") | dict.fromkeys(set(here) - set(manifest), "added")
    both = sorted(set(manifest) & set(here))
    out |= {n: "changed" for n in both if here[n][0] != manifest[n][0]}
    same = [n for n in both if n not in out]
    if same:
        out |= {r.name: "changed" for r in digests(spark, root, same).collect() if r.sha256 != manifest[r.name][1]}
    return dict(sorted(out.items()))


def check_sources(spark: SparkSession, root: str, manifest: Mapping[str, tuple[int, str]]) -> None:
    if odd := drift(spark, root, manifest):
        raise ValueError(f"files differ from the manifest: {odd}")


def listing_digest(spark: SparkSession, root: str) -> str:
    """Changes when a file below is added, removed, or has another length or time; reads none of them."""
    return hashlib.sha256(json.dumps(sorted((n, *v) for n, v in Files(spark, root).listed().items())).encode()).hexdigest()


def canonical(x: object) -> object:
    """Plain lists, mappings and values of a plan, in an order of their own; what has no plain form is an error."""
    if x is None or isinstance(x, (bool, int, str)):
        return x
    if isinstance(x, float):
        return {"float": x.hex()}
    if isinstance(x, Mapping):
        return {"map": sorted(([canonical(k), canonical(v)] for k, v in x.items()), key=json.dumps)}
    if isinstance(x, (list, tuple)):
        return [canonical(v) for v in x]
    if isinstance(x, (set, frozenset)):
        return {"set": sorted((canonical(v) for v in x), key=json.dumps)}
    if hasattr(x, "__dataclass_fields__"):
        return {type(x).__name__: [[n, canonical(getattr(x, n))] for n in x.__dataclass_fields__]}
    if hasattr(x, "isoformat"):
        return {type(x).__name__: x.isoformat()}
    raise TypeError(f"{type(x).__name__} has no canonical form")


def key_of(plan: object, sources: Mapping[str, str], code: str = "") -> str:
    """Of a plan, the digests of its sources and of the code: equal for equal ones, whatever order mappings are in."""
    return hashlib.sha256(json.dumps([LAYOUT, canonical(plan), canonical(sources), code]).encode()).hexdigest()


@dataclass
class Store:
    """Prepared tables below ``root``, each set under a key. Entries are written aside and renamed when whole, so none is ever half there."""

    spark: SparkSession
    root: str

    def get(self, key: str, deep: bool = False) -> dict[str, DataFrame] | None:
        """An entry's tables, or None where there is none that is whole.

        An entry counts if its own list of files, with their lengths, is what is there; ``deep`` also reads the tables and compares their
        fingerprints. One that doesn't is moved aside and counts as missing.
        """
        files = Files(self.spark, self.root)
        raw = files.read(f"{key}/{MANIFEST}")
        if raw is None:
            return None
        try:
            entry = json.loads(raw)
            body = {k: entry[k] for k in ("layout", "files", "tables")}
            whole = entry["digest"] == _sealed(body) and entry["layout"] == LAYOUT
            here = {n.removeprefix(f"{key}/"): length for n, (length, _) in files.listed(key).items() if not n.endswith(f"/{MANIFEST}")}
            whole = whole and here == entry["files"]
            tables = {n: self.spark.read.schema(t["schema"]).parquet(f"{files.root}/{key}/{n}") for n, t in entry["tables"].items()} if whole else {}
            if whole and deep:
                whole = all(list(fingerprint(df).first()[:2]) == entry["tables"][n]["fingerprint"] for n, df in tables.items())
        except (ValueError, KeyError, TypeError, AttributeError):
            whole = False
        except Exception:  # a table that can't be read
            if not deep:
                raise
            whole = False
        if not whole:
            files.rename(key, f"broken-{key}-{uuid.uuid4().hex}")
            return None
        return tables

    def put(self, key: str, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Write tables under a key and read them again. Of two writers at once the first to finish is kept, and both read that."""
        if not tables or any(n != inside(n) or "/" in n or n.startswith(("_", ".")) for n in tables):
            raise ValueError("tables need plain names")
        files, aside = Files(self.spark, self.root), f".making-{uuid.uuid4().hex}"
        try:
            known = {}
            for n, df in tables.items():
                df.write.parquet(f"{files.root}/{aside}/{n}")
                again = self.spark.read.schema(df.schema).parquet(f"{files.root}/{aside}/{n}")
                # a schema by its own simple form; names with odd letters are quoted
                known[n] = {"schema": ", ".join(f"`{c.replace('`', '``')}` {k}" for c, k in df.dtypes), "fingerprint": list(fingerprint(again).first()[:2])}
            body = {"layout": LAYOUT, "files": {n.removeprefix(f"{aside}/"): length for n, (length, _) in files.listed(aside).items()}, "tables": known}
            files.write(f"{aside}/{MANIFEST}", json.dumps(body | {"digest": _sealed(body)}).encode())
            files.rename(aside, key)
        finally:
            files.delete(aside)
        found = self.get(key)
        if found is None:
            raise OSError(f"entry {key} did not come about")
        return found

    def get_or_make(self, key: str, make: Callable[[], Mapping[str, DataFrame]]) -> tuple[dict[str, DataFrame], bool]:
        """(tables, whether they were there): ``make`` is called only where they weren't."""
        found = self.get(key)
        return (found, True) if found is not None else (self.put(key, make()), False)


def _sealed(body: Mapping) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
