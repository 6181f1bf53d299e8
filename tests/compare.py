"""Rows of a Spark query and of its DuckDB SQL, to be compared without order."""

import glob
import os

import duckdb


def connection(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.sql(f"create view {name} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def rows_of_spark(df):
    cols = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(cols).collect()), key=repr)


def rows_of_sql(sf_dir, text, columns):
    quoted = ", ".join(f'"{c}"' for c in sorted(columns))
    return sorted(connection(sf_dir).sql(f"select {quoted} from ({text})").fetchall(), key=repr)
