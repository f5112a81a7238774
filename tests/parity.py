"""Comparison of a query with its DuckDB equivalent on the driver's tables."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def connect():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def compare(spark, con, query, sql):
    got = query(spark, DATA)
    answer = con.execute(sql)
    names = [c[0] for c in answer.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in answer.fetchall()), key=repr)
    assert ours == theirs
