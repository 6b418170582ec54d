"""Run a registered query on Spark and its SQL on DuckDB over the same files and compare rows and types."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

KINDS = {
    "byte": "int", "short": "int", "integer": "int", "long": "int", "float": "double", "double": "double", "string": "text",
    "boolean": "bool", "date": "date", "timestamp_ntz": "time", "timestamp": "time",
}
DUCK_KINDS = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "FLOAT": "double", "DOUBLE": "double",
    "VARCHAR": "text", "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "time", "TIMESTAMP_S": "time", "TIMESTAMP_MS": "time", "TIMESTAMP_NS": "time",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def spark_rows(df):
    names = sorted(df.columns)
    kinds = {f.name: KINDS.get(f.dataType.typeName(), f.dataType.simpleString()) for f in df.schema.fields}
    rows = [tuple(plain(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    return names, [kinds[n] for n in names], Counter(rows)


def duck_rows(con, sql: str):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    kinds = [DUCK_KINDS.get(str(rel.types[i]), str(rel.types[i]).lower().replace(" ", "")) for i in order]
    rows = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    return [rel.columns[i] for i in order], kinds, rows


def differences(spark_side, duck_side) -> str | None:
    names, kinds, rows = spark_side
    dnames, dkinds, drows = duck_side
    if names != dnames:
        return f"columns {names} != {dnames}"
    if kinds != dkinds:
        return f"types {dict(zip(names, kinds))} != {dkinds}"
    if rows != drows:
        only_s, only_d = rows - drows, drows - rows
        return f"{sum(rows.values())} vs {sum(drows.values())} rows; spark only {list(only_s.items())[:3]}; sql only {list(only_d.items())[:3]}"
    return None
