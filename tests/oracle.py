"""Comparison of a query with its SQL over one data folder."""

from collections import Counter
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.01")


def database(folder=DATA):
    db = duckdb.connect()
    for path in folder.iterdir():
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.execute(f"create view {path.stem} as select * from '{files}'")
    return db


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def compare(spark, queries, sql, name, folder=DATA):
    got = queries[name](spark, str(folder))
    columns = sorted(got.columns)
    want = database(folder).execute(f"select {', '.join(columns)} from ({sql[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert Counter(map(plain, rows)) == Counter(map(plain, want))
    assert rows, "an empty result compares nothing"
