"""Compare a Spark result with DuckDB's."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(rows):
    return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


def agree(df, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    got = cells(df.select(*[f"`{c}`" for c in want.columns]).collect())
    assert got == cells(want.fetchall())
