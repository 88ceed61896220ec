"""Run a registered query and its SQL on the same tables and compare them."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    df = df.map(lambda x: float(x) if isinstance(x, (float, bool)) or hasattr(x, "dtype") and x.dtype.kind in "fb" else x)
    key = df.map(repr).agg("|".join, axis=1) if len(df) else pd.Series(dtype=str)
    return df.iloc[key.argsort(kind="stable")].reset_index(drop=True)


def differences(query, sql: str, spark, sf_dir: str, con) -> str:
    """Empty if both give the same rows."""
    got, want = normal(query(spark, sf_dir).toPandas()), normal(con.execute(sql).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} and {list(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    bad = [c for c in got.columns if not all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) < 1e-9) for a, b in zip(got[c], want[c]))]
    return "" if not bad else f"columns {bad}: " + str([(a, b) for a, b in zip(got[bad[0]], want[bad[0]]) if a != b][:3])
