"""The exponentially weighted standardiser on a stream: state for each entity, late rows answered from a buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.temporal import decay, ewma_scores

OUT = "entity long, t timestamp, z double, replayed boolean"
STATE = "mean double, var double, last long, times array<long>, scores array<double>"


def standardise(stream: DataFrame, half_life: float, mean: float = 0.0, var: float = 1.0, floor: float = 1e-12, kept: int = 64, priors: DataFrame | None = None) -> DataFrame:
    """``entity, t, z, replayed`` from a stream of ``entity, t, v``.

    Rows are taken in time order within a micro-batch. A row at or before the entity's last time gets its earlier answer, if it is
    among the last ``kept``; an older one fails the query, for its state is gone. An entity starts from its own row in ``priors``
    (``entity, mean, var``, a table that the stream is joined with), else from ``mean`` and ``var``.
    """
    lam = decay(half_life)
    rows = stream.select("entity", "t", F.col("v").cast("double").alias("v"))
    if priors is not None:
        own = priors.select("entity", F.col("mean").cast("double").alias("m"), F.col("var").cast("double").alias("s"))
        rows = rows.join(own, "entity", "left").select("entity", "t", "v", F.coalesce("m", F.lit(mean)).alias("m"), F.coalesce("s", F.lit(var)).alias("s"))
    else:
        rows = rows.select("*", F.lit(float(mean)).alias("m"), F.lit(float(var)).alias("s"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(parts)).sort_values("t", kind="stable")
        m, s, last, times, scores = state.get if state.exists else (part["m"].iloc[0], part["s"].iloc[0], None, [], [])
        at = part["t"].astype("datetime64[us]").astype("int64").to_numpy()
        new = np.append(True, np.diff(at) != 0) & (True if last is None else at > last)
        z, m, s = ewma_scores(part["v"].to_numpy(np.float64)[new], float(m), float(s), lam, floor)
        known = dict(zip(times, scores, strict=True)) | dict(zip(at[new].tolist(), z.tolist(), strict=True))
        if gone := [x for x in at.tolist() if x not in known]:
            raise ValueError(f"row of entity {key[0]} at {pd.Timestamp(gone[0], unit='us')} is older than the replay buffer")
        times, scores = [*times, *at[new].tolist()][-kept:], [*scores, *z.tolist()][-kept:]
        state.update((float(m), float(s), times[-1] if times else last, times, scores))
        yield pd.DataFrame({"entity": key[0], "t": part["t"], "z": [known[x] for x in at.tolist()], "replayed": ~new})

    return rows.groupBy("entity").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
