"""Runs a query and its SQL over the same tables and compares the rows as bags."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{d}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def norm(x):
    return round(x, 9) if isinstance(x, float) else x


def compare(spark, d, query, sql):
    df = query(spark, d)
    cur = connect(d).execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    assert got == want
