"""Spark results against DuckDB's, as multisets of rows with columns in name order."""

import datetime as dt
import math
from decimal import Decimal
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dt.date):
        return str(v)
    return float(v) if isinstance(v, Decimal) else v


def duck(folder):
    con = duckdb.connect()
    for p in sorted(Path(folder).iterdir()):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return con


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
