"""Runs a registered query beside its SQL and compares their rows."""

from __future__ import annotations

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connection(folder: str = DATA):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def ordered(rows, columns):
    names = sorted(columns)
    at = [list(columns).index(c) for c in names]
    return names, sorted((tuple(r[k] for k in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, query, sql: str, folder: str = DATA) -> None:
    df = query(spark, folder)
    rel = con.sql(sql)
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(rel.fetchall(), rel.columns)
