"""Compare a Spark result with DuckDB's: names, types, rows as a multiset."""

from __future__ import annotations

import collections
import datetime
import decimal
import glob
import math
import os

import duckdb

_KINDS = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "string": "text", "double": "float",
    "float": "float", "boolean": "bool", "timestamp_ntz": "time", "timestamp": "time", "date": "date",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.10g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], collections.Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    mine = _table(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = _table(names, result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if not mine[1]:
        return "no rows"
    if mine[1] != theirs[1]:
        only_mine, only_theirs = mine[1] - theirs[1], theirs[1] - mine[1]
        return (
            f"rows {mine[1].total()} vs {theirs[1].total()}; only Spark {only_mine.total()} {list(only_mine)[:3]};"
            f" only DuckDB {only_theirs.total()} {list(only_theirs)[:3]}"
        )
    types = {d[0]: str(d[1]).lower() for d in result.description}
    return _type_mismatch(df, types)


def _type_mismatch(df, types):
    duck = {
        "bigint": "bigint", "integer": "int", "smallint": "smallint", "tinyint": "tinyint", "varchar": "string",
        "double": "double", "float": "float", "boolean": "boolean", "timestamp": "timestamp_ntz", "date": "date",
    }
    for name, spark_type in df.dtypes:
        other = types[name]
        if duck.get(other, other.replace(" ", "")) != spark_type:
            return f"type of {name}: {spark_type} vs {other}"
    return None
