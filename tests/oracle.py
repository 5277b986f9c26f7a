"""Comparison of a Spark result with the rows DuckDB gives for its SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

DATA = os.environ.get("MILLWRIGHT_TESTDATA", "/root/testdata")


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def _cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple(sorted((k, _cell(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(_cell(v) for v in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, bool) or isinstance(x, str):
        return x
    if isinstance(x, (int, float)):
        return float(x)
    return str(x)


def rows_of(records, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in records), key=repr)


def compare(df, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    spark_rows = [tuple(r) for r in df.collect()]
    con = connection(sf_dir)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    duck_rows = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    for name, kind in df.dtypes:
        want = kinds[name].upper()
        if (kind in ("double", "float")) != (want in ("DOUBLE", "FLOAT")) or "DECIMAL" in want or "HUGEINT" in want:
            return f"column {name}: {kind} and {want}"
    a, b = rows_of(spark_rows, df.columns), rows_of(duck_rows, columns)
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; only Spark: {str(only_a)[:600]}; only SQL: {str(only_b)[:600]}"
