"""Holds a query's rows against those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def connection(sf_dir: str):
    c = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        c.sql(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}'")
    return c


def _plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return "null" if x is None else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


def assert_same(df, sql: str, sf_dir: str) -> None:
    made = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(made.columns)
    mine, theirs = rows(df.columns, df.collect()), rows(made.columns, made.fetchall())
    assert len(mine) == len(theirs)
    different = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not different, different[:5]
