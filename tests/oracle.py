"""Comparing a query with its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return float(f"{v:.10g}")
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


def rows_of_sql(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def assert_same(df, sql, folder):
    names, expected = rows_of_sql(sql, folder)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(value(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(value(r[names.index(c)]) for c in order) for r in expected), key=repr)
    assert got == want
