"""Runs a query's SQL in DuckDB and compares rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql, sf_dir=None, **frames):
    con = duckdb.connect()
    for t in TABLES if sf_dir else []:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, (types, rows) in frames.items():
        con.execute(f"CREATE TABLE {name} ({types})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def same(df, names, rows):
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    at = [names.index(c) for c in df.columns]
    tidy = lambda v: f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v)
    got = sorted(tuple(map(tidy, r)) for r in df.collect())
    want = sorted(tuple(tidy(r[i]) for i in at) for r in rows)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert g == w
