"""The standardiser on a stream agrees with the one on a table, row by row, where both start from the same priors."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import temporal
from quantloom.panel import Panel
from quantloom.streaming.ewma import standardise

SCHEMA = "entity long, t timestamp, v double"
T = dt.datetime(2021, 1, 1)


def run(spark, tmp_path, parts, **kw):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = standardise(stream, 4.0, **kw).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.read.schema("entity long, t timestamp, z double, replayed boolean").parquet(f"{tmp_path}/out").collect()


def test_priors_by_entity_as_on_a_table(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = {e: [None if rng.random() < 0.2 else float(x) for x in rng.normal(5 * e, 1 + e, 30)] for e in range(4)}
    rows = [(e, T + dt.timedelta(hours=i), v) for e, vs in values.items() for i, v in enumerate(vs)]
    late = [r for r in rows if r[0] == 1 and 8 <= (r[1] - T).seconds // 3600 <= 9 and r[1].day == 1]
    first = [r for r in rows if r[1] < T + dt.timedelta(hours=11)]
    second = [r for r in rows if r[1] >= T + dt.timedelta(hours=11)] + late + [rows[-1]]  # two late rows, and one twice in a batch
    table = spark.createDataFrame([r for r in rows if r[0] < 3], SCHEMA).toDF("e", "d", "x")
    priors = table.groupBy(F.col("e").alias("entity")).agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    got = run(spark, tmp_path, [first, second], priors=priors, mean=1.0, var=2.0)
    assert sum(r.replayed for r in got) == len(late) + 1 and len(got) == len(rows) + len(late) + 1
    want = {(r.e, r.d): r.z for r in temporal.ewma_standardise(Panel(table), Panel(table), "x", 4.0).collect()}
    alone, _, _ = temporal.ewma_scores(np.array([np.nan if v is None else v for v in values[3]]), 1.0, 2.0, temporal.decay(4.0), 1e-12)  # no prior of its own
    want |= {(3, T + dt.timedelta(hours=i)): z for i, z in enumerate(alone.tolist())}
    assert {(r.entity, r.t) for r in got} == set(want)
    assert all(abs(r.z - want[r.entity, r.t]) < 1e-9 for r in got)


def test_older_than_the_buffer(spark, tmp_path):
    rows = [(1, T + dt.timedelta(hours=i), float(i)) for i in range(9)]
    with pytest.raises(Exception, match="older than the replay buffer"):
        run(spark, tmp_path, [rows, [rows[2]]], kept=3)
