"""Holds a query's rows against its SQL, which DuckDB runs on the same tables."""

import math
from pathlib import Path

import duckdb


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([cell(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def expected(sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    con.execute("SET TimeZone = 'UTC'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def compare(df, sql, sf_dir):
    names, rows = expected(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(rows), (len(got), len(rows))
    mine, theirs = rows_of(df.columns, got), rows_of(names, rows)
    for a, b in zip(mine, theirs, strict=True):
        assert a == b, (a, b)
