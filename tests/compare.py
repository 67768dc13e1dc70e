"""Spark results against DuckDB's."""

from collections import Counter

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    return None if pd.isna(v) else str(v + 0.0 if isinstance(v, float) and v else v)


def rows(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(map(_cell, r)) for r in df[columns].astype(object).itertuples(index=False))


def assert_same(spark_df, con, sql):
    got, want = rows(spark_df.toPandas()), rows(con.sql(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1], f"{list((got[1] - want[1]).items())[:3]} but {list((want[1] - got[1]).items())[:3]}"
