"""Comparison of a query's rows with its SQL's, whatever the order."""

import math

import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else f"{v:.6g}"
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def check(name, queries, sql, spark, sf, duck):
    got = queries[name](spark, sf).toPandas()
    want = duck.execute(sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
