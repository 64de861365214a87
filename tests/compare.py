"""Compare a query's rows with its SQL in DuckDB, without regard to order."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

from tessera.sources import TABLES


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x) if isinstance(x, datetime.date) else x


def differences(df, sql: str, directory: str) -> list[str]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    return [f"missing {list((want - got).items())[:2]}", f"more {list((got - want).items())[:2]}"] if want != got else []
