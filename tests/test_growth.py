"""What larger tables showed: results that hang on the order of rows, and work that outgrows its input."""

import datetime as dt
import glob
import random

import duckdb
import numpy as np
import pyarrow.parquet as pq

from pyspark.sql import functions as F

from quantloom.llm import common, queries, suffix_dedup, url_filter
from quantloom.operators import factor_analysis, inference
from quantloom.operators import series_tests as st
from quantloom.operators import signals as sg
from quantloom.operators import temporal
from quantloom.panel import Panel
from quantloom.plans import registry


def test_means_of_user_days_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Events that lie in any order over many files give the sums that a read in order gives, to the last bit."""
    values = [0.1, 0.7, 1e3 + 0.01, 0.3, 77.77, 0.2, 5.55, 1e6 + 0.1, 0.6, 33.33]
    rows = [(i, dt.datetime(2024, 1, 1 + i % 2, 1), i % 3, values[i * 7 % 10] * (1 + i % 5)) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").repartition(40, "value").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for _, ts, user, value in rows:
        total, n = want.get((ts.date(), user), (0.0, 0))
        want[ts.date(), user] = total + value, n + 1
    got = {(r.d, r.e): (r.v, r.k) for r in registry.usr(spark, str(tmp_path)).collect()}
    assert got == {k: (total / n, n) for k, (total, n) in want.items()}


def test_roc_of_events_in_many_files_equals_its_sql_read_in_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, dt.datetime(2024, 1, 1 + rng.randrange(5)), rng.randrange(40), round(rng.expovariate(0.02), 2)) for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").repartition(30, "value").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create table events as select * from '{tmp_path}/events.parquet/*.parquet' order by event_id")
    want = con.execute(registry.ORACLE_SQL["signal_roc"]).fetchall()
    assert sorted(want) == sorted(map(tuple, registry.QUERIES["signal_roc"](spark, str(tmp_path)).collect()))


def test_corrections_of_any_number_of_hypotheses(spark):
    """Ties, missing values, zeros and families with a null name, against plain loops; and no sweep to the end of a family from each row."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0.0, 1e-9, 0.02, 0.02, 1.0, rng.random(), rng.random() ** 4])) for i in range(900)]
    df = spark.createDataFrame(rows, "i long, f string, p_value double")
    for family in ([], ["f"]):
        groups = {}
        for i, f, p in rows:
            if p is not None:
                groups.setdefault(f if family else 0, []).append((p, i))
        for how in ("holm", "bh"):
            want = {i: None for i, _, p in rows if p is None}
            for g in groups.values():
                g, n = sorted(g), len(g)
                x = [p * (n - k) if how == "holm" else p * n / (k + 1) for k, (p, _) in enumerate(g)]
                for k, (_, i) in enumerate(g):
                    want[i] = min(1.0, max(x[: k + 1]) if how == "holm" else min(x[k:]))
            found = sg.adjust(df, how=how, family=family, order=["i"])
            assert found.columns == ["i", "f", "p_value", "adjusted"] and {r.i: r.adjusted for r in found.collect()} == want
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "currentrow$(), unboundedfollowing$()" not in plan


def test_rows_of_a_regression_move_once(spark):
    """One shuffle by the series' key serves the sums, the join with their solution (which moves, a row a series) and the lags; a null key is a series too."""
    rng = random.Random(8)
    rows = [(m, dt.date(2024, 1, 1) + dt.timedelta(i), rng.random(), rng.random()) for m in ("a", "b", None) for i in range(40)]
    found = st.regress(spark.createDataFrame(rows, "m string, d date, y double, x double"), ["m"], "d", "y", ["x"])
    assert found._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS") <= 1
    got = {r.m: r for r in found.collect()}
    assert set(got) == {"a", "b", None}
    for m, r in got.items():
        y, x = (np.array([row[k] for row in rows if row[0] == m]) for k in (2, 3))
        beta, cov, r2 = inference.hac_ols(y, x[:, None])
        assert r.n == 40 and np.allclose(r.coefficients, beta) and np.allclose(r.covariance, cov.ravel()) and abs(r.r_squared - r2) < 1e-9


def test_a_regression_starts_no_job_and_writes_its_rows_to_one_shuffle(spark):
    """Each series has the lags of its own length's bandwidth, or those asked for, without a look at the longest; its sums and its lags read the same shuffle."""
    rng = random.Random(9)
    sizes = {"a": 2, "b": 5, "c": 60, "d": 450, None: 130}
    rows = [(m, dt.date(2024, 1, 1) + dt.timedelta(i), rng.random(), rng.random()) for m, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "m string, d date, y double, x double")
    for lag in (None, 0, 3, 1000):
        spark.sparkContext.setJobGroup(f"planned {lag}", "")
        found = st.regress(df, ["m"], "d", "y", ["x"], lag)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"planned {lag}")
        got = {r.m: r for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("REPARTITION_BY_COL") == 2 and plan.count("ReusedExchange") == 1
        assert {m: r.n for m, r in got.items()} == sizes and got["a"].coefficients is None
        for m in ("b", "c", "d", None):
            y, x = (np.array([row[k] for row in sorted(rows, key=lambda r: r[1]) if row[0] == m]) for k in (2, 3))
            beta, cov, r2 = inference.hac_ols(y, x[:, None], lag)
            assert np.allclose(got[m].coefficients, beta) and np.allclose(got[m].covariance, cov.ravel(), rtol=1e-9, atol=0) and abs(got[m].r_squared - r2) < 1e-9
    spark.sparkContext._jsc.clearJobGroup()
    assert st.regress(df.where("m = 'c'"), [], "d", "y", ["x"]).first().n == 60 and not st.regress(df.limit(0), [], "d", "y", ["x"]).collect()


def test_models_meet_the_factors_of_a_date_where_they_lie(spark):
    """Factors are a row a date, however many models: they are broadcast, and no model's rows are dealt by date. Dates without factors are left out, a date that is there twice counts twice."""
    rng = random.Random(10)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    daily = [(m, day(i) if i else None, rng.random()) for m in ("a", "b", None) for i in range(50)]
    factors = [(day(i), rng.random(), rng.random() if i != 7 else float("nan")) for i in [*range(1, 40), 20]]
    series = factor_analysis.series_for(design := factor_analysis.Design(("f", "g"), "f"), Panel(spark.createDataFrame(factors, "d date, f double, g double"), entity=None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = factor_analysis.analyse(spark.createDataFrame(daily, "m string, d date, y double"), "m", "y", design, series).tables["alpha"]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(d" not in plan and "BroadcastHashJoin [d" in plan
        got = {r.m: r for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(got) == {"a", "b", None} and {r.n for r in got.values()} == {39}
    for m, r in got.items():
        both = [(y, f, g) for k, d, y in daily for e, f, g in factors if k == m and d == e and g == g]
        beta, _, r2 = inference.hac_ols(np.array([x[0] for x in both]), np.array([x[1:] for x in both]))
        assert np.allclose([r.alpha, r.betas["f"], r.betas["g"], r.r_squared], [*beta, r2])


def test_a_standardised_panel_is_shuffled_once_with_its_priors(spark):
    """Priors and scores read one shuffle; an entity without values and rows without an entity start from the pooled prior, as with a train of its own."""
    rng = random.Random(11)
    rows = [(e, dt.date(2024, 1, 1) + dt.timedelta(i), None if e == 3 or rng.random() < 0.2 else rng.gauss(e or 9, 2)) for e in (1, 2, 3, None) for i in range(60)]
    rows += [(4, dt.date(2024, 1, 1), 5.0), (4, dt.date(2024, 1, 2), 7.0), (4, dt.date(2024, 1, 2), 7.0), (4, None, 6.0)]
    p = Panel(spark.createDataFrame(rows, "e int, d date, x double").repartition(7))
    order = lambda r: (str(r[0]), str(r[1] or ""), r[2])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = temporal.ewma_standardise(p, p, "x", 5.0)
        got = sorted(((r.e, r.d, r.z) for r in found.collect()), key=order)
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("ReusedExchange") == 2 and "Window" not in plan  # both priors read the shuffle of the rows; no history is held
        other = sorted(((r.e, r.d, r.z) for r in temporal.ewma_standardise(p, Panel(p.df), "x", 5.0).collect()), key=order)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lam, want = temporal.decay(5.0), []
    for e in (1, 2, 3, 4, None):
        values = np.array([x for k, _, x in rows if x is not None and (k == e or e in (3, None))])
        m, s = values.mean(), values.var()
        for _, d, x in sorted((r for r in rows if r[0] == e), key=lambda r: str(r[1] or "")):
            z = 0.0 if x is None else (x - m) / s**0.5
            m, s = (m, s) if x is None else (m + (1 - lam) * (x - m), lam * (s + (1 - lam) * (x - m) ** 2))
            want.append((e, d, z))
    want.sort(key=order)
    for have in (got, other):
        assert [r[:2] for r in have] == [r[:2] for r in want] and np.allclose([r[2] for r in have], [r[2] for r in want])


def test_verdicts_of_pages_are_never_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    """2.7 million verdicts lie in 11 MB of files and take hundreds in memory: only hot pages, of which there are a thousand at most, go through the driver."""
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.example.com/en/"), (F.col("id") % 700).cast("string")).alias("url"))
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    plans = []
    monkeypatch.setattr(url_filter, "durable", lambda df, tag: (plans.append(df._jdf.queryExecution().executedPlan().toString()), common.durable(df, tag))[1])
    for most, join in ((url_filter.RULES, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(url_filter, "RULES", most)
        found = url_filter.url_filter(pages, rules)
        hit = [x for x in plans.pop().splitlines() if "Join" in x and "rule_host" in x]
        assert len(hit) == 1 and join in hit[0] and "BuildLeft" not in hit[0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftOuter" in x]
    assert {(r.rule, r.verdict) for r in found.collect()} == {("example.com/en/", "block")} and found.count() == 2000
    big = spark.range(3000).select("id", (F.col("id") % 900).cast("string").alias("k"))
    small = common.durable(big.groupBy("k").agg(F.count("*").alias("n")), "small")
    for how in ("inner", "left"):
        joined = common.keyed_join(big, small, ["k"], "n", how)
        assert joined.count() == 3000 and "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_rows_of_megabytes_are_written_and_read_a_few_at_a_time(spark, monkeypatch):
    """A hundred rows of megabytes were one page of a file, which a writer and a reader hold whole."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "".join(rng.choices("abcdefgh ", k=700_000))) for i in range(24)], "doc_id long, text string").coalesce(1)
    tables = {}
    monkeypatch.setattr(suffix_dedup, "durable", lambda df, tag, **how: tables.setdefault(tag, common.durable(df, tag, **how)))
    found = suffix_dedup.suffix_dedup(docs)
    files = glob.glob(f"{tables['blocks']._durable_path.removeprefix('file://')}/*.parquet")
    groups = [g.row_group(i) for g in (pq.ParquetFile(f).metadata for f in files) for i in range(g.num_row_groups)]
    assert sum(g.num_rows for g in groups) == tables["blocks"].count() > suffix_dedup.BLOCKS and max(g.num_rows for g in groups) <= suffix_dedup.BLOCKS
    assert found.where("octet_length(kept) = n_bytes and n_bytes = 700000").count() == 24
    # whoever writes them: no limit of rows, but of bytes
    rows = spark.range(40).coalesce(1).select(F.repeat(F.sha2(F.col("id").cast("string"), 512), 8192).alias("x"))
    at = common.durable(rows.select(F.expr("concat(x, uuid())").alias("x")), "rows", codec="none")._durable_path
    meta = [pq.ParquetFile(f).metadata for f in glob.glob(f"{at.removeprefix('file://')}/*.parquet")]
    assert max(m.row_group(i).total_byte_size for m in meta for i in range(m.num_row_groups)) <= 20 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b"


def test_starts_are_judged_in_pieces(spark, monkeypatch):
    """Any size of the pieces gives the same spans."""
    rng = random.Random(6)
    parts = ["".join(rng.choices("abcd ", k=rng.randrange(60, 200))) for _ in range(12)]
    docs = spark.createDataFrame([(i, "".join(rng.choices(parts, k=6))) for i in range(60)], "doc_id long, text string")
    seen = set()
    for size in (1, 7, 1000, 1 << 18):
        monkeypatch.setattr(suffix_dedup, "AT_ONCE", size)
        seen.add(str(sorted(map(str, suffix_dedup.suffix_dedup(docs).collect()))))
    assert len(seen) == 1 and "spans=[[" in seen.pop()
