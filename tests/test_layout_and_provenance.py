"""Sorted tables whose layout the planner uses, and manifests that cost no second scan."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quantloom.operators.features import build_features
from quantloom.panel import Panel
from quantloom.sources import layout, provenance

SPECS = [{"op": "log_change", "column": "x", "horizon": 2, "as": "m"}, {"op": "rolling_volatility", "column": "x", "window": 3, "shift": 1, "as": "v"}]


@pytest.fixture
def panel(spark):
    df = spark.range(600).select(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("d"), (F.col("id") % 20).alias("e"), (1 + F.col("id") * 7 % 13).cast("double").alias("x"))
    return Panel(df.dropDuplicates(["d", "e"]))


@pytest.fixture
def name(spark):
    made = "sorted_panel_of_a_test"
    spark.sql(f"DROP TABLE IF EXISTS {made}")
    yield made
    spark.sql(f"DROP TABLE IF EXISTS {made}")


def test_features_over_a_sorted_table_need_no_exchange(spark, panel, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = layout.write_sorted(panel, name, 4)
        built = build_features(stored, SPECS).df
        assert layout.exchanges(build_features(panel, SPECS).df) > 0 and layout.exchanges(built) == 0
        joined = built.join(stored.df, ["e", "d"]).groupBy("e").agg(F.avg("m"))
        assert layout.exchanges(joined) == 0
        assert sorted(map(str, built.collect())) == sorted(map(str, build_features(panel, SPECS).df.collect()))
        with pytest.raises(Exception):
            layout.write_sorted(panel, name, 4)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset(layout.ORDERED)
        spark.conf.unset(layout.ALL_KEYS)


def test_what_has_no_index(spark, panel, name):
    with pytest.raises(ValueError, match="no time or no entity"):
        layout.write_sorted(panel.with_df(panel.df.withColumn("e", F.when(F.col("e") > 3, F.col("e")))), name)
    with pytest.raises(ValueError):
        layout.write_sorted(Panel(panel.df.drop("e"), entity=None), name)
    assert [layout.buckets_for(n) for n in (0, 1, 5_000_000, 5_000_001, 11_000_000, 10**9)] == [1, 1, 1, 2, 4, 256]
    rows = [(r.e, r.d) for r in layout.sort_by_index(panel).df.collect()]
    assert rows == sorted(rows)


def test_manifest_without_a_second_scan(spark, panel, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    df = panel.df.withColumn("x", counted("x")).withColumn("none", F.when(F.col("e") < 5, F.lit("a")))
    n = panel.df.count()
    body = provenance.write_analytics(spark, f"{tmp_path}/out", {"one": df, "none": df.limit(0)}, {"k": [1, 2.5]}, {"raw": "abc"})
    assert seen.value <= 2 * n  # each table's rows pass once, however many facts are gathered
    one = body["tables"]["one"]
    assert one["rows"] == n and one["nulls"] == {"d": 0, "e": 0, "x": 0, "none": df.where("e >= 5").count()} and body["tables"]["none"]["rows"] == 0
    again, tables = provenance.read_analytics(spark, f"{tmp_path}/out", check=True)
    assert again == json.loads(json.dumps(body)) and tables["one"].count() == n
    assert body["code"] == provenance.code_digest() and body["environment"]["spark"] == spark.version
    with pytest.raises(FileExistsError):
        provenance.write_analytics(spark, f"{tmp_path}/out", {"one": df})
    with pytest.raises(ValueError):
        provenance.write_analytics(spark, f"{tmp_path}/other", {"_x": df})
    with pytest.raises(FileNotFoundError):
        provenance.read_analytics(spark, f"{tmp_path}/nowhere")


def test_changes_are_noticed(spark, panel, tmp_path):
    provenance.write_analytics(spark, f"{tmp_path}/out", {"one": panel.df})
    panel.df.limit(3).write.mode("overwrite").parquet(f"{tmp_path}/out/one")
    provenance.read_analytics(spark, f"{tmp_path}/out")
    with pytest.raises(ValueError, match="isn't what was written"):
        provenance.read_analytics(spark, f"{tmp_path}/out", check=True)
    body = json.load(open(f"{tmp_path}/out/_analytics.json"))
    body["tables"]["one"]["rows"] = 3
    os.remove(f"{tmp_path}/out/._analytics.json.crc")
    json.dump(body, open(f"{tmp_path}/out/_analytics.json", "w"))
    with pytest.raises(ValueError, match="was changed"):
        provenance.read_analytics(spark, f"{tmp_path}/out")


def test_plan_digests(panel):
    build = lambda k: panel.df.where(F.col("x") > k).groupBy("e").agg(F.sum("x").alias("s"))
    assert provenance.plan_digest(build(3)) == provenance.plan_digest(build(3)) != provenance.plan_digest(build(4))


def test_models_still_score_after_an_observed_write(spark, panel, tmp_path):
    """A session that has observed a write can't be sent to tasks; the write has its own."""
    from quantloom.operators import models

    provenance.write_table(panel.df, f"{tmp_path}/x")
    df = panel.df.select("x", (F.col("e") % 3).cast("double").alias("y0"), (F.col("x") > 6).cast("int").alias("y"))
    assert models.fit_classifier(df, ["x", "y0"], "y").score(df).count() == panel.df.count()
    assert not spark.catalog.listTables("global_temp") or not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("observed_")]
