"""Compare a registered query with its SQL in DuckDB: column names, types, row count and values."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import duckdb

from storelytics.sources.bound import DRIVER_SCHEMAS

DATA = "/root/testdata/sf0.001"


def connect(folder: str):
    con = duckdb.connect()
    for name in DRIVER_SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return ("num", str(value.normalize()))
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, (int, float)):
        return ("num", str(decimal.Decimal(repr(value)).normalize()))
    if isinstance(value, datetime.datetime):
        return ("time", value.isoformat())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_plain(r[i]) for i in order) for r in rows)


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DOUBLE": "double",
}


def differences(df, con, sql: str) -> list[str]:
    cur = con.execute(sql)
    their_names = [d[0] for d in cur.description]
    theirs = rows_of(their_names, cur.fetchall())
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    ours = rows_of(df.columns, df.collect())
    out = []
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} vs {theirs[0]}"]
    for name, kind in df.dtypes:
        want = KINDS.get(types[name], types[name].lower())
        if kind != want:
            out.append(f"type of {name}: {kind} vs {want}")
    if ours[1] != theirs[1]:
        extra, missing = ours[1] - theirs[1], theirs[1] - ours[1]
        out.append(f"rows {sum(ours[1].values())} vs {sum(theirs[1].values())}; "
                   f"only here {list(extra)[:2]}; only there {list(missing)[:2]}")
    return out
