"""Compare a query's rows with its oracle's, as sets of rows with columns sorted by name."""

from __future__ import annotations

import decimal
import math
import os
from collections import Counter

import duckdb

from strandloom.plans.views import TABLES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def compare(df, con, sql: str) -> None:
    relation = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: KINDS.get(t, t) for c, t in df.dtypes if t in KINDS} == {c: kinds[c] for c, t in df.dtypes if t in KINDS}
    want = Counter(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    found = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert found == want
