"""Stationary bootstrap of any number of date series: any task can draw any resample, and a block costs one lookup.

The random numbers of block ``k`` of resample ``r`` are the digits of a hash of (seed, r, k), so nothing depends on who
draws them or in what order. A resample's sums are differences of prefix sums over the series laid twice end to end, for
blocks wrap around. Series are arrays in rows of their own; but for the prefix sums all is expressions on them, in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import EPS
from . import inference
from . import series_tests as st

#: Values of a series at most: it has to fit a row.
MOST_DATES = 100_000
#: Resamples that one row of the work draws.
CHUNK = 250


def _arrays(rows: DataFrame, by: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """``by, n`` and for each column its values in order of time; longer series than ``MOST_DATES`` are an error."""
    packed = rows.groupBy(*by).agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct(time, *columns))).alias("_rows"))
    checked = F.when(F.col("n") > MOST_DATES, F.raise_error(F.lit("not a date series"))).otherwise(F.col("n"))
    return packed.select(*by, checked.cast("int").alias("n"), *[F.col("_rows").getField(c).alias(c) for c in columns])


def _prefix_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column replaced by 0 and its running sums, laid twice end to end."""

    @F.arrow_udf("array<double>")
    def sums(x: pa.Array) -> pa.Array:
        return pa.array([np.append(0.0, np.cumsum(np.tile(v, 2))) for v in x.to_pylist()], pa.list_(pa.float64()))

    return df.withColumns({c: sums(c) for c in columns})


def drawn(n: Column, prefixes: Sequence[Column], r: Column, block: float, seed: int) -> Column:
    """For resample ``r``, the sum of each column over all drawn positions, as an array.

    A block's first position is uniform, its length geometric with mean ``block``; blocks follow until ``n`` positions are drawn, the
    last one cut. The last of 2 n / block + 10 blocks takes what is left, if ever so many are needed.
    """
    most = F.ceil(2 * n / F.lit(max(block, 1.0))).cast("int") + 10

    def step(state: Column, k: Column) -> Column:
        digits = F.md5(F.concat_ws(":", F.lit(str(seed)), r.cast("string"), k.cast("string")).cast("binary"))
        u, v = ((F.conv(F.substring(digits, at, 12), 16, 10).cast("long") + 0.5) / float(1 << 48) for at in (1, 13))
        length = F.lit(1) if block <= 1 else F.floor(F.log(u) / F.lit(math.log1p(-1 / block))).cast("int") + 1
        taken = F.when(k == most - 1, state["left"]).otherwise(F.least(length, state["left"]))
        start = F.floor(v * n).cast("int")
        sums = [state[f"s{i}"] + F.get(p, start + taken) - F.get(p, start) for i, p in enumerate(prefixes)]
        return F.when(state["left"] == 0, state).otherwise(F.struct((state["left"] - taken).alias("left"), *[s.alias(f"s{i}") for i, s in enumerate(sums)]))

    first = F.struct(n.alias("left"), *[F.lit(0.0).alias(f"s{i}") for i in range(len(prefixes))])
    return F.aggregate(F.sequence(F.lit(0), most - 1), first, step, lambda s: F.array(*[s[f"s{i}"] for i in range(len(prefixes))]))


def resampled(df: DataFrame, by: Sequence[str], time: str, values: dict[str, Column], times: int, block: float, seed: int) -> DataFrame:
    """``by, n, r, sums``: for each series and each resample, the sums of ``values`` (by name) over what it drew.

    All of a series' values must be there in a row for it to count. Series of the same length draw the same positions.
    """
    names = list(values)
    rows = st._complete(df.withColumns(values), by, time, names)
    work = _prefix_sums(_arrays(rows, by, time, names), names)
    chunks = math.ceil(times / CHUNK)
    work = work.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    ids = F.sequence(F.col("_chunk") * CHUNK, F.least((F.col("_chunk") + 1) * CHUNK, F.lit(times)) - 1)
    # rows are spread anew, for a few long series make many resamples
    work = work.repartition(max(chunks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by, "_chunk")
    sums = F.transform(ids, lambda r: F.struct(r.alias("r"), drawn(F.col("n"), [F.col(c) for c in names], r, block, seed).alias("sums")))
    return work.select(*by, "n", F.inline(sums))


def _sharpe(n: Column, s1: Column, s2: Column, center: Column) -> Column:
    """Mean over sample deviation, from the sums of values less ``center`` and of their squares."""
    sd = F.sqrt(F.greatest(F.lit(0.0), (s2 - s1 * s1 / n) / (n - 1)))
    return F.when(sd > EPS, (s1 / n + center) / sd)


def sharpe_significance(daily: DataFrame, by: Sequence[str], time: str, excess: str, periods: int = 252, lag: int | None = None, times: int = 2000, block: float = 10, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """``by, annualized_sharpe, sharpe_t_statistic, sharpe_p_value, sharpe_ci_low, sharpe_ci_high, n`` of each series.

    The test is the one-sided HAC test of the mean, the interval holds the middle ``confidence`` of resampled ratios. Missing values don't
    count; a series under two values or without spread has no ratio.
    """
    rows = st._complete(daily, by, time, [excess])
    moments = rows.groupBy(*by).agg(F.avg(excess).alias("_mean"), F.stddev_samp(excess).alias("_sd"))
    centred = st._same(rows, moments, by).select(*by, time, excess, (F.col(excess) - F.col("_mean")).alias("_x"))
    boot = st._same(resampled(centred, by, time, {"_x": F.col("_x"), "_xx": F.col("_x") * F.col("_x")}, times, block, seed), moments, by)
    ratio = _sharpe(F.col("n"), F.get("sums", F.lit(0)), F.get("sums", F.lit(1)), F.col("_mean")) * math.sqrt(periods)
    tail = (1 - confidence) / 2
    between = boot.where("n >= 2").withColumn("_r", ratio).groupBy(*by).agg(F.percentile("_r", F.array(F.lit(tail), F.lit(1 - tail))).alias("_ci"))
    test = st._same(st.hac_mean(rows, by, time, excess, 0.0, lag, "greater"), moments, by)
    keys = [f"_key_{i}" for i in range(len(by))]
    ends = between.withColumnsRenamed(dict(zip(by, keys)))
    on = [F.col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, by)] or [F.lit(True)]
    found = test.join(ends, on, "left")
    return found.select(
        *by, F.when(F.col("_sd") > EPS, F.col("_mean") / F.col("_sd") * math.sqrt(periods)).alias("annualized_sharpe"), F.col("t").alias("sharpe_t_statistic"), F.col("p_value").alias("sharpe_p_value"),
        F.get("_ci", F.lit(0)).alias("sharpe_ci_low"), F.get("_ci", F.lit(1)).alias("sharpe_ci_high"), "n",
    )


def sharpe_differences(daily: DataFrame, model: str, time: str, excess: str, periods: int = 252, times: int = 2000, block: float = 10, seed: int = 42) -> DataFrame:
    """``a, b, sharpe_difference, z_statistic, z_p_value, bootstrap_p_value, n`` of each pair of models, on the dates both have.

    The z is Memmel's. The bootstrap draws the same positions of both; its p-value is the share of resampled differences, centred,
    that are as large as the one observed, which itself counts as one. Under three dates, or without spread, all are null.
    """
    rows = st._complete(daily.select(F.col(model).alias("a"), time, F.col(excess).alias("_x")), ["a"], time, ["_x"])
    both = rows.join(rows.select(F.col("a").alias("b"), time, F.col("_x").alias("_y")), time).where("a < b")
    by = ["a", "b"]
    moments = both.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.stddev_samp("_x").alias("_sx"), F.stddev_samp("_y").alias("_sy"), F.covar_samp("_x", "_y").alias("_c"))
    moments = moments.where((F.col("n") >= 3) & (F.col("_sx") > EPS) & (F.col("_sy") > EPS))
    x, y, n = F.col("_mx") / F.col("_sx"), F.col("_my") / F.col("_sy"), F.col("n")
    rho = F.col("_c") / (F.col("_sx") * F.col("_sy"))
    v = (2 - 2 * rho + (x * x + y * y - 2 * x * y * rho * rho) / 2) / n
    moments = moments.withColumns({"_d": x - y, "_z": F.when(v > EPS * EPS, (x - y) / F.sqrt(F.abs(v)))})
    centred = both.join(moments.select(*by, "_mx", "_my"), by).select(*by, time, (F.col("_x") - F.col("_mx")).alias("_x"), (F.col("_y") - F.col("_my")).alias("_y"))
    values = {"_x": F.col("_x"), "_xx": F.col("_x") * F.col("_x"), "_y": F.col("_y"), "_yy": F.col("_y") * F.col("_y")}
    boot = resampled(centred, by, time, values, times, block, seed).drop("n").join(moments, by)
    s = [F.get("sums", F.lit(i)) for i in range(4)]
    far = F.abs(_sharpe(n, s[0], s[1], F.col("_mx")) - _sharpe(n, s[2], s[3], F.col("_my")) - F.col("_d")) >= F.abs(F.col("_d"))
    p = boot.groupBy(*by).agg(((1 + F.sum(far.cast("int"))) / (times + 1.0)).alias("bootstrap_p_value"))
    names = both.groupBy(*by).agg(F.count("*").alias("n"))
    found = names.join(moments.drop("n"), by, "left").join(p, by, "left")
    return found.select(*by, (F.col("_d") * math.sqrt(periods)).alias("sharpe_difference"), F.col("_z").alias("z_statistic"), st.normal_p("_z").alias("z_p_value"), "bootstrap_p_value", "n")


def confidence_set(daily: DataFrame, by: Sequence[str], model: str, time: str, loss: str, alpha: float = 0.1, times: int = 1000, block: float = 10, seed: int = 42) -> DataFrame:
    """``by, model, mcs_p_value, in_confidence_set, mean_loss``: the models of each family that can't be told from its best.

    Dates count that every model of the family has. Losses alike on all dates share a verdict; with one model, or under two dates, all
    stay and have no p-value. Resampled means are made by Spark for all families at once; what a task then holds is one family's means,
    models times ``times``, from which the worst model goes by the range statistic until one is left.
    """
    rows = st._complete(daily, [*by, model], time, [loss])
    sizes = rows.groupBy(*by).agg(F.countDistinct(model).alias("_m"))
    here = st._same(rows.groupBy(*by, time).agg(F.count("*").alias("_k")), sizes, by).where("_k = _m").drop("_k", "_m")
    keys = {c: f"_date_{i}" for i, c in enumerate([*by, time])}
    whole = rows.join(here.withColumnsRenamed(keys), [F.col(k).eqNullSafe(F.col(c)) for c, k in keys.items()], "left_semi")
    # of models with equal losses one is resampled
    means = whole.groupBy(*by, model).agg(F.avg(loss).alias("mean_loss"), F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct(time, loss))).getField(loss).alias("_path"))
    boot = resampled(whole, [*by, model], time, {loss: F.col(loss)}, times, block, seed)
    boot = boot.select(*by, model, "r", (F.get("sums", F.lit(0)) / F.col("n")).alias("_v")).groupBy(*by, model).agg(F.array_sort(F.collect_list(F.struct("r", "_v"))).getField("_v").alias("_boot"))
    joined = st._same(means, boot, [*by, model]).withColumn("_alike", F.sha2(F.array_join(F.transform("_path", lambda x: x.cast("string")), ","), 256)).drop("_path")
    group = list(by) or ["_one"]
    joined = joined if by else joined.withColumn("_one", F.lit(1))
    kinds = dict(joined.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"`{model}` {kinds[model]}", "mcs_p_value double", "in_confidence_set boolean", "mean_loss double"])

    def eliminate(family: pa.Table) -> pa.Table:
        alike, mean, n = family["_alike"].to_pylist(), np.asarray(family["mean_loss"]), family["_n"][0].as_py()
        firsts = sorted({a: i for i, a in reversed(list(enumerate(alike)))}.values(), key=lambda i: alike[i])
        p = dict.fromkeys(alike, None if len(alike) < 2 or n < 2 else 1.0)
        if len(firsts) > 1 and n > 1:
            boot = np.stack([np.asarray(family["_boot"][i].values) for i in firsts], axis=1)
            p = dict(zip([alike[i] for i in firsts], inference.eliminated(mean[firsts], boot).tolist(), strict=True))
        ps = [p[a] for a in alike]
        out = {c: family[c] for c in [*by, model]} | {"mcs_p_value": pa.array(ps, pa.float64()), "in_confidence_set": pa.array([x is None or x >= alpha for x in ps]), "mean_loss": family["mean_loss"]}
        return pa.table(out)

    return joined.groupBy(*group).applyInArrow(eliminate, schema)


def significance_frame(daily: DataFrame, per_date: DataFrame, model: str, time: str, excess: str = "excess_return", periods: int = 252, lag: int | None = None, ic_lag: int | None = None, times: int = 2000, block: float = 10, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """One row a model with all its tests: Sharpe ratio, excess profitability, rank coefficient and directional accuracy.

    ``daily`` has the models' excess returns, ``per_date`` what of ``hit_rate``, ``excess_profit`` and ``rank_ic`` there is by model and date; tests
    without input are left out. A model that one table lacks has nulls there.
    """
    found = sharpe_significance(daily, [model], time, excess, periods, lag, times, block, seed, confidence).drop("n")
    tests = {
        "excess_profit": lambda: st.excess_profitability(per_date, [model], time, "excess_profit", lag),
        "rank_ic": lambda: st.information_coefficient(per_date, [model], time, "rank_ic", periods, lag if ic_lag is None else ic_lag, confidence),
        "hit_rate": lambda: st.directional_accuracy(per_date, [model], time, "hit_rate", 0.5, lag),
    }
    for column, test in tests.items():
        if column in per_date.columns:
            found = found.join(test().drop("n"), model, "full_outer")
    return found


def symmetric(pairs: DataFrame, value: str, diagonal: float | None = None) -> DataFrame:
    """``row, column, value`` of the whole matrix from each unordered pair (``a, b``), with ``diagonal`` on the diagonal."""
    cells = pairs.select(F.col("a").alias("row"), F.col("b").alias("column"), F.col(value).alias("value"))
    ends = cells.select("row").union(cells.select("column")).distinct()
    own = ends.select("row", F.col("row").alias("column"), F.lit(diagonal).cast("double").alias("value"))
    return cells.unionByName(cells.select(F.col("column").alias("row"), F.col("row").alias("column"), "value")).unionByName(own)
