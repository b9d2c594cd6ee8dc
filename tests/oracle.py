"""Run a registered query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from lossledger.sources.tables import TABLE_NAMES


def duck(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> str | None:
    """None when equal, else a short description of the difference."""
    spark_rows = df.collect()
    cur = con.execute(sql)
    duck_columns = [d[0] for d in cur.description]
    duck_rows = cur.fetchall()
    if sorted(df.columns) != sorted(duck_columns):
        return f"columns {sorted(df.columns)} != {sorted(duck_columns)}"
    kinds = [
        {c: {type(r[i]) for r in rows if r[i] is not None} for i, c in enumerate(columns)}
        for columns, rows in ((df.columns, spark_rows), (duck_columns, duck_rows))
    ]
    for c in df.columns:
        if kinds[0][c] != kinds[1][c] or not kinds[0][c] <= {int, float, str, bool}:
            return f"types of {c}: {kinds[0][c]} and {kinds[1][c]}"
    a, b = rows_of(df.columns, spark_rows), rows_of(duck_columns, duck_rows)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows; e.g. {a[:1]} / {b[:1]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None
