"""Spark queries against DuckDB on the same tables: names, counts and values, in any order."""

import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(x):
    return int(x) if isinstance(x, Decimal) and x == int(x) else round(x, 6) if isinstance(x, float) else x


def same(spark, connection, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    cursor = connection.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names, (columns, names)
    order = [columns.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    got = Counter(tuple(plain(x) for x in r) for r in df.select(*names).collect())
    assert sum(got.values()) == sum(want.values()), (sum(got.values()), sum(want.values()))
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
