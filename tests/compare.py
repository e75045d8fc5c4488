"""Comparing a query with its SQL as sets of rows, whatever their order."""

import math


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if isinstance(v, (int, str)) else str(v)


def rows_of(df, columns=None):
    names = columns or sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def assert_same(df, con, sql):
    names = sorted(df.columns)
    cur = con.execute(sql)
    found = [d[0] for d in cur.description]
    assert sorted(found) == names
    at = [found.index(c) for c in names]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert rows_of(df, names) == expected
