"""The driver's comparison in small: a query's rows against its SQL in DuckDB, without order."""

import math
import os
from datetime import date, datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float) and math.isnan(x):
        return "None"
    if isinstance(x, (int, float)):
        return repr(round(float(x), 7) + 0.0)
    return x.isoformat() if isinstance(x, (date, datetime)) else str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_plain(v[i]) for i in order) for v in values)


def same(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
