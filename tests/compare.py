"""Rows of Spark and DuckDB as comparable multisets."""

import math
from decimal import Decimal


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(df, con, sql):
    """Rows, after asserting that columns and rows agree."""
    columns = sorted(df.columns)
    left = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    r = con.sql(sql)
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    right = sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
    assert left == right
    return left
