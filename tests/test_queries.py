"""Every registered query against its SQL on DuckDB, over whole tables."""

import math

import duckdb
import pandas as pd
import pytest

from quantloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)[:10] if hasattr(v, "year") and str(v).endswith("00:00:00") else str(v)


def rows(df, numeric):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(cell(float(v)) if c in numeric and v is not None and v is not pd.NA and v == v else cell(v) for c, v in zip(sorted(df.columns), r)))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got)
        return
    want = con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    numeric = {c for c in got.columns if pd.api.types.is_numeric_dtype(got[c]) or pd.api.types.is_numeric_dtype(want[c])}
    assert rows(got, numeric) == rows(want, numeric)
