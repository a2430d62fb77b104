"""Compares a query with its SQL, whatever the order of rows and columns."""

from __future__ import annotations

import math


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def assert_same(df, relation):
    got, want = rows_of(df.columns, df.collect()), rows_of(relation.columns, relation.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    wrong = [x for x in zip(got[1], want[1], strict=True) if x[0] != x[1]]
    assert not wrong, wrong[:3]
