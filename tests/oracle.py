"""Comparison of a query with its DuckDB statement, as multisets of rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {t} as select * from '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([r[i] for i in order] for r in rows), key=repr)


def both(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    rel = connect(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    return rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
