"""Rates of a user with most of the events: in blocks of time, against sequential rules."""

import random

import pytest

from kelpwood.operators import runs


def events():
    r = random.Random(4)
    us = [r.randrange(40_000_000) // 50_000 * 50_000 for _ in range(1500)]
    return [(i, None if i % 101 == 0 else "hot" if i % 3 else f"u{i % 7}", t, r.uniform(-1, 5)) for i, t in enumerate(us)]


@pytest.fixture
def points(spark, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK_ROWS", 100, raising=False)
    return spark.createDataFrame(events(), "id long, user string, us long, amount double")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def by_user():
    users = {}
    for i, u, t, a in sorted(events(), key=lambda e: (e[2], e[0])):
        users.setdefault(u, []).append((i, t, a))
    return users


def test_smoothed_gathers_no_list(points):
    df = runs.smoothed(points, "user")
    assert "collect_list" not in plan(df)
    want = {}
    for u, rows in by_user().items():
        want[u] = rows[0][2]
        for _, _, a in rows[1:]:
            want[u] = want[u] * 0.8 + a * 0.2
    got = {r.user: r.smoothed for r in df.collect()}
    assert got.keys() == want.keys() and all(got[u] == pytest.approx(want[u]) for u in want)


@pytest.mark.parametrize("seconds", [0.5, 3.0])
def test_trailing_rate_runs_in_blocks(points, seconds):
    df = runs.trailing_rate(points, "user", seconds)
    windows = [line for line in plan(df).splitlines() if "windowspecdefinition" in line]
    assert windows and all("block" in line for line in windows)
    want = {}
    for rows in by_user().values():
        total, totals = 0.0, []
        for i, t, a in rows:
            total += a
            totals.append((i, t, total))
        for i, t, s in totals:
            near = [(t2, s2) for _, t2, s2 in totals if t - seconds * 1e6 <= t2 <= t]
            span = (t - min(near)[0]) / 1e6
            want[i] = (s - min(s2 for _, s2 in near)) / span if span > 0.25 else None
    got = {r.id: r.rate for r in df.collect()}
    assert got.keys() == want.keys()
    assert all((got[i] is None) == (want[i] is None) and (want[i] is None or got[i] == pytest.approx(want[i], abs=1e-9)) for i in want)
