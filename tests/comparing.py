"""Rows of a Spark query against those of SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame(index=df.index)
    for c in sorted(df.columns):
        try:
            out[c] = pd.to_numeric(df[c].astype(float)).fillna(-9.5e99)
        except (TypeError, ValueError):
            out[c] = df[c].astype(str).where(df[c].notna(), "~")
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def assert_same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    pd.testing.assert_frame_equal(plain(a), plain(b), check_exact=True)
