"""Runs a registered query and its SQL side by side and compares the rows."""

import os

import duckdb
import numpy as np
import pandas as pd


def views(sf_dir: str):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = pd.to_numeric(df[c]).astype(float).round(5)
        else:
            df[c] = df[c].astype(str).replace({"None": "", "<NA>": "", "nan": ""})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(got: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) == len(expected)
    a, b = plain(got), plain(expected)
    for c in a:
        x, y = a[c].to_numpy(), b[c].to_numpy()
        if a[c].dtype == float and b[c].dtype == float:
            np.testing.assert_allclose(x, y, atol=2e-5, equal_nan=True, err_msg=c)
        else:
            assert list(x) == list(y), c
