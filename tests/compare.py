"""Comparing a DataFrame with DuckDB's answer: columns, types of value, rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def _value(v):
    if isinstance(v, float):
        return ("float", None if math.isnan(v) else v + 0.0)
    if isinstance(v, decimal.Decimal):
        return ("decimal", v)
    if isinstance(v, datetime.datetime):
        return ("time", v.isoformat())
    return (type(v).__name__, v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    out = [tuple(_value(row[i]) for i in order) for row in rows]
    return sorted(out, key=repr)


def differences(df, connection, sql: str) -> list[str]:
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = _rows(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows != {len(theirs)} rows"]
    return [f"{a} != {b}" for a, b in zip(ours, theirs) if a != b][:3]
