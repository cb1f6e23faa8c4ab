"""Manifests and the store of prepared tables: what they notice, and what they don't read."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quantloom.plans.spec import Plan, prepared
from quantloom.sources import ColumnSpec, View
from quantloom.sources import store as st


def put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)


@pytest.fixture
def raw(tmp_path):
    rng = random.Random(1)
    files = {"a.csv": b"x\n1\n", "deep/er/b.bin": rng.randbytes(300_001), "empty": b"", "odd name é%20#.txt": b"odd"}
    for n, c in files.items():
        put(f"{tmp_path}/raw/{n}", c)
    return f"{tmp_path}/raw", files


def test_digests_in_pieces(spark, raw):
    root, files = raw
    for piece in (7, 4096, 1 << 20):
        got = {r.name: (r.length, r.sha256) for r in st.digests(spark, root, piece=piece).collect()}
        assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}
    got = {r.name: r.sha256 for r in st.digests(spark, root, ["a.csv", "gone"]).collect()}
    assert got["gone"] is None and got["a.csv"]
    assert st.digests(spark, f"{root}/nowhere").count() == 0


def test_a_large_file_is_never_one_value(spark, tmp_path):
    """A sparse file beyond what a value of the engine may hold."""
    os.makedirs(f"{tmp_path}/big")
    size, h = (2 << 30) + 5, hashlib.sha256()
    with open(f"{tmp_path}/big/f", "wb") as f:
        f.truncate(size)
    for _ in range(size >> 20):
        h.update(bytes(1 << 20))
    h.update(bytes(5))
    row = st.digests(spark, f"{tmp_path}/big").first()
    assert (row.length, row.sha256) == (size, h.hexdigest())


def test_manifest_round_trip_and_drift(spark, raw, tmp_path):
    root, files = raw
    target = f"{tmp_path}/meta/m.json"
    st.write_manifest(spark, root, target)
    known = st.read_manifest(spark, target)
    assert known == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()} and st.drift(spark, root, known) == {}
    st.check_sources(spark, root, known)
    put(f"{root}/a.csv", b"x\n2\n")  # as long as before
    put(f"{root}/empty", b"no more")
    put(f"{root}/new", b"")
    os.remove(f"{root}/deep/er/b.bin")
    assert st.drift(spark, root, known) == {"a.csv": "changed", "deep/er/b.bin": "missing", "empty": "changed", "new": "added"}
    with pytest.raises(ValueError, match="differ from the manifest"):
        st.check_sources(spark, root, known)
    with pytest.raises(Exception):
        st.write_manifest(spark, root, target)  # a manifest isn't overwritten
    with pytest.raises(FileNotFoundError):
        st.read_manifest(spark, f"{tmp_path}/meta/none.json")


@pytest.mark.parametrize("name", ["../secret", "/etc/passwd", "a/../../b", "file:///x", "..", "a\\..\\b"])
def test_paths_that_lead_out(spark, raw, tmp_path, name):
    with pytest.raises(ValueError, match="leads out"):
        st.digests(spark, raw[0], [name])
    put(f"{tmp_path}/bad.json", json.dumps({"layout": 1, "files": {name: [1, "0" * 64]}}).encode())
    with pytest.raises(ValueError):
        st.read_manifest(spark, f"{tmp_path}/bad.json")


def test_entries_that_are_none(spark, tmp_path):
    for i, content in enumerate([{"layout": 9, "files": {}}, {"layout": 1, "files": {"a": [-1, "0" * 64]}}, {"layout": 1, "files": {"a": [1, "xyz"]}}, {"layout": 1, "files": {"a/./b": [1, "0" * 64]}}]):
        put(f"{tmp_path}/{i}.json", json.dumps(content).encode())
        with pytest.raises(ValueError):
            st.read_manifest(spark, f"{tmp_path}/{i}.json")


def test_keys():
    view = View("p", ("d", ColumnSpec("date", "date")), columns={"x": ColumnSpec("a"), "y": ColumnSpec("b")})
    turned = View("p", ("d", ColumnSpec("date", "date")), columns={"y": ColumnSpec("b"), "x": ColumnSpec("a")})
    a = Plan({"p": view}, "p", features={"p": [{"op": "log_change", "column": "x", "horizon": 1}]})
    assert st.key_of(a, {"p": "1", "q": "2"}) == st.key_of(Plan({"p": turned}, "p", features={"p": [{"horizon": 1, "op": "log_change", "column": "x"}]}), {"q": "2", "p": "1"})
    others = [Plan({"p": view}, "p"), Plan({"p": view}, "p", features={"p": [{"op": "log_change", "column": "x", "horizon": 1.0}]})]
    keys = {st.key_of(a, {"p": "1"}), st.key_of(a, {"p": "2"}), st.key_of(a, {"p": "1"}, "code"), *(st.key_of(o, {"p": "1"}) for o in others)}
    assert len(keys) == 5
    with pytest.raises(TypeError):
        st.key_of(lambda: 0, {})


def test_store(spark, tmp_path):
    store, calls = st.Store(spark, f"{tmp_path}/store"), []
    df = spark.range(100).select("id", F.col("id").cast("string").alias("a `b"), F.array(F.col("id") / 3).alias("xs"))

    def make():
        calls.append(1)
        return {"one": df, "two": df.limit(0)}

    first, hit = store.get_or_make("k", make)
    again, hit2 = store.get_or_make("k", make)
    assert (hit, hit2, len(calls)) == (False, True, 1) and again["one"].schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, again["one"].select("id").collect())) == [(i,) for i in range(100)] and again["two"].count() == 0
    assert store.get("k", deep=True) and store.get("other") is None
    with pytest.raises(ValueError):
        store.put("x", {"../y": df})
    with pytest.raises(ZeroDivisionError):
        store.get_or_make("fails", lambda: 1 / 0)
    assert store.get("fails") is None
    names = os.listdir(f"{tmp_path}/store")
    assert not [n for n in names if n.startswith(".making") and not n.endswith(".crc")]


@pytest.mark.parametrize("how", ["cut", "gone", "added", "manifest", "json", "bits"])
def test_broken_entries_are_misses(spark, tmp_path, how):
    store = st.Store(spark, f"{tmp_path}/store")
    store.put("k", {"t": spark.range(50).toDF("x")})
    at = f"{tmp_path}/store/k"
    part = next(f"{at}/t/{n}" for n in os.listdir(f"{at}/t") if n.startswith("part"))
    for crc in [f"{os.path.dirname(part)}/.{os.path.basename(part)}.crc", f"{at}/._manifest.json.crc"]:
        os.remove(crc)  # changes that the file system itself doesn't notice
    content = open(part, "rb").read()
    if how == "cut":
        put(part, content[:-1])
    elif how == "gone":
        os.remove(part)
    elif how == "added":
        put(f"{at}/t/part-9.parquet", content)
    elif how == "bits":
        put(part, content[:40] + bytes(9) + content[49:])
    else:
        raw = json.load(open(f"{at}/_manifest.json"))
        raw["files"]["t/x"] = 1
        put(f"{at}/_manifest.json", b"{" if how == "json" else json.dumps(raw).encode())
    assert store.get("k", deep=how == "bits") is None
    made, hit = store.get_or_make("k", lambda: {"t": spark.range(3).toDF("x")})
    assert not hit and made["t"].count() == 3


def test_a_writer_that_comes_second(spark, tmp_path):
    store = st.Store(spark, f"{tmp_path}/store")
    store.put("k", {"t": spark.range(5).toDF("x")})
    assert store.put("k", {"t": spark.range(9).toDF("x")})["t"].count() == 5


def test_a_prepared_plan_reads_its_sources_once(spark, tmp_path):
    put(f"{tmp_path}/src/p.csv", b"date,id,close\n" + b"".join(b"2020-01-0%d,%d,%d\n" % (i, e, 100 + i * e) for i in range(1, 7) for e in (1, 2)))
    time, entity = ("d", ColumnSpec("date", "date", "yyyy-MM-dd")), ("e", ColumnSpec("id", "bigint"))
    plan = Plan({"p": View(f"{tmp_path}/src/p.csv", time, entity, {"close": ColumnSpec("close")})}, "p", {"p": [("deduplicate", {})]}, {"p": [{"op": "simple_change", "column": "close", "as": "r"}]})
    store = st.Store(spark, f"{tmp_path}/store")
    first, hit = prepared(spark, plan, store, {"p": "digest"})
    want = sorted(map(str, first.df.collect()))
    os.remove(f"{tmp_path}/src/p.csv")  # nothing left to read
    again, hit2 = prepared(spark, plan, store, {"p": "digest"})
    assert (hit, hit2) == (False, True) and sorted(map(str, again.df.collect())) == want and (again.time, again.entity) == (first.time, first.entity)
    put(f"{tmp_path}/src/p.csv", b"date,id,close\n2020-01-01,1,5\n")
    one, hit = prepared(spark, plan, store)  # by the listing
    put(f"{tmp_path}/src/p.csv", b"date,id,close\n2020-01-01,1,5\n2020-01-02,1,6\n")
    two, hit2 = prepared(spark, plan, store)
    assert not hit and not hit2 and (one.df.count(), two.df.count()) == (1, 2)
    with pytest.raises(ValueError):
        prepared(spark, Plan(plan.sources, "gone"), store)
