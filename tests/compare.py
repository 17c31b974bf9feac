"""Rows of Spark and DuckDB in one form."""

import math
import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def alike(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= 1e-8 * max(1, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(alike, a, b))
    return a == b


def ordered(rows):
    def key(r):
        return [f"{x:.6g}" if isinstance(x, float) else str(x) for x in r]

    return sorted(rows, key=key)


def same_result(df, relation):
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    theirs = relation.columns
    mine = ordered(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = ordered(tuple(plain(r[theirs.index(c)]) for c in cols) for r in relation.fetchall())
    assert len(mine) == len(want)
    for a, b in zip(mine, want):
        assert alike(a, b), (cols, a, b)
