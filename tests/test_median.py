import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from kelpwood.operators.contain import meeting, moving_medians, walk


def bound(counts):
    return min(v + sum(c > v for c in counts) for v in counts)


@given(hs.lists(hs.integers(2, 40), min_size=1, max_size=60), hs.lists(hs.integers(2, 40), max_size=40))
@settings(max_examples=300, deadline=None)
def test_walks_that_meet_stay_together_and_medians_are_bounded(counts, before):
    m, _ = walk(before, 0)
    most = bound(counts + before)
    assert 0 <= m <= most
    t, out, rest, met = meeting(counts, m % 2, max(m % 2, most - (most - m) % 2))
    got, here = walk(counts[:t], m)
    assert (out if met else got, here + rest) == walk(counts, m)


@pytest.mark.parametrize("kind", ["random", "rising", "falling", "spikes", "waves", "few"])
def test_equals_the_fold(spark, kind):
    r = random.Random(kind)
    n = 3 if kind == "few" else 4000
    counts = {
        "random": lambda i: r.choice([1, 2, 2, 3, 5, 9]), "rising": lambda i: i + 1, "falling": lambda i: n - i + 1, "spikes": lambda i: 10**6 if i % 97 == 0 else 2,
        "waves": lambda i: 2 if i // 300 % 2 else 300, "few": lambda i: i,
    }[kind]
    rows = [("s", i * 1000 + r.randrange(1000), counts(i)) for i in range(n)] + [(None, i, 3) for i in range(50)] + [("t", 5, 1)]
    want = {}
    for s in ("s", None):
        want[s] = walk([c for x, _, c in sorted(rows, key=lambda x: x[1]) if x == s and c > 1], 0)[1]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "sample string, h long, cnt long")
    assert {x.sample: x.depth_sum for x in moving_medians(df, 100).collect()} == want
