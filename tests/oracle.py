"""Rows of a query and of its SQL, as comparable text."""

from __future__ import annotations

import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def same_rows(spark, query, sql):
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    mine = query(spark, FOLDER)
    names = sorted(mine.columns)
    given = connection.execute(sql)
    theirs = [d[0] for d in given.description]
    assert sorted(theirs) == names
    text = lambda x: repr(round(x, 6)) if isinstance(x, float) else str(x)
    left = sorted([text(r[n]) for n in names] for r in mine.collect())
    right = sorted([text(r[theirs.index(n)]) for n in names] for r in given.fetchall())
    assert left == right
