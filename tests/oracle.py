"""Comparison of a Spark result with DuckDB's over the same tables."""

import glob
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return c


def _shown(rows, other):
    """Values as text; whole numbers beside a null are floats in one frame and integers in the other."""
    rows = rows.copy()
    for c in rows.columns:
        if rows[c].isna().any() and "float" in str(rows[c].dtype) and "int" in str(other[c].dtype).lower():
            rows[c] = rows[c].astype("Int64")
    return rows.astype(str)


def assert_same(found, expected):
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    a, b = _shown(found[columns], expected), _shown(expected[columns], found)
    a, b = a.sort_values(columns).reset_index(drop=True), b.sort_values(columns).reset_index(drop=True)
    assert len(a) == len(b)
    for c in columns:
        assert (a[c] == b[c]).all(), (c, a[c][a[c] != b[c]].head(3).tolist(), b[c][a[c] != b[c]].head(3).tolist())
