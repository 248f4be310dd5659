"""Compare a Spark query with its SQL in DuckDB, row by row and order-blind."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def differences(spark, sf_dir: str, run, sql: str) -> str | None:
    """None when both sides agree, else a short account of what differs."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(_plain(row[n]) for n in names) for row in df.collect())
    result = connect(sf_dir).execute(sql)
    sql_names = [d[0] for d in result.description]
    if sorted(sql_names) != names:
        return f"columns {names} against {sorted(sql_names)}"
    at = [sql_names.index(n) for n in names]
    want = Counter(tuple(_plain(row[i]) for i in at) for row in result.fetchall())
    if got == want:
        return None
    extra, missing = got - want, want - got
    show = lambda c: [tuple(str(v)[:80] for v in r) for r in list(c)[:2]]
    return (
        f"{sum(got.values())} rows against {sum(want.values())}; columns {names}; "
        f"only Spark ({sum(extra.values())}): {show(extra)}; only SQL ({sum(missing.values())}): {show(missing)}"
    )
