"""A query's rows against its SQL in DuckDB over every driver table."""

import glob
import os

import duckdb

from oracle import differences


def mismatch(spark, name, folder="/root/testdata/sf0.01"):
    from storelytics.llm import queries

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return differences(queries.queries()[name](spark, folder), con, queries.oracle_sql()[name])
