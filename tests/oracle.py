"""Comparing a DataFrame with a DuckDB query over the same tables."""

import os
from collections import Counter
from functools import lru_cache

import duckdb
import pandas as pd


@lru_cache(maxsize=4)
def tables(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def bag(df, cols):
    def plain(v):
        """Whole numbers as int: columns with nulls come as floats from one side and as nullable integers from the other."""
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return v if not isinstance(v, float) else int(v) if v.is_integer() else float(v)

    return Counter(str([plain(v) for v in row]) for row in df[cols].astype(object).values.tolist())


def assert_same(got, sql, sf_dir):
    want = tables(sf_dir).execute(sql).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    a, b = bag(got, cols), bag(want, cols)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
    return len(got)
