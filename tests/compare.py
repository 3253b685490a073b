"""A Spark query against its DuckDB SQL: same columns, same rows in any order."""

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if hasattr(x, "quantize"):
        return round(float(x), 5)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((v is not None, str(type(v)), v) for v in r)
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=key)


def difference(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows; {got[1][:2]} and {want[1][:2]}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(bad)} of {len(got[1])} rows differ, such as {bad[0]}" if bad else None
