"""Run a registered query and its SQL, and compare the rows without regard to order."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb
from pyspark.sql import DataFrame

from workload.common import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9) + 0.0
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([repr([_plain(r[i]) for i in order]) for r in rows])


def compare(df: DataFrame, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    want_columns, want = [d[0] for d in result.description], result.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} / {sorted(want_columns)}"
    a, b = _rows(got_columns, got), _rows(want_columns, want)
    if a == b:
        return None
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return f"rows {len(a)} / {len(b)}\n  spark only {only_a}\n  sql only   {only_b}"
