import random

import numpy as np
import pytest
from compare import DATA

from kelpwood.functions.kmers import _mixed, unmixed
from kelpwood.operators import cuckoo
from kelpwood.operators.cuckoo import SLOTS, ScalableFilter, approximate_sketch
from kelpwood.operators.sketch import sample_sketch
from kelpwood.plans import engine


@pytest.mark.parametrize("fpr", [1e-2, 1e-4])
def test_no_false_negatives_and_few_false_positives(fpr):
    r = np.random.default_rng(3)
    items = np.unique(r.integers(0, 1 << 63, 60_000, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 60_000, dtype=np.uint64))
    r.shuffle(items)
    known = ScalableFilter(fpr, 64)
    for at in range(0, len(items), 7001):
        part = items[at : at + 7001]
        known.add(part[~known.has(part)])
    assert len(known.filters) > 3 and known.has(items).all()
    strangers = r.integers(0, 1 << 63, 400_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    strangers = strangers[~np.isin(strangers, items)]
    assert known.has(strangers).mean() <= fpr
    bits, held = known.bits_held()
    assert held <= len(items) and bits / held < 120


@pytest.mark.parametrize("cap", [None, 4])
def test_equals_the_exact_form_but_for_false_positives(spark, cap):
    r = random.Random(5)
    rows = []
    for i in range(6000):
        h = int(r.paretovariate(0.4)) % 300
        a, b = r.choice([(None, None), (r.randrange(40), r.randrange(40)), (7, 7)])
        rows.append((r.choice(["s", "t", None]), h, i * 10 + r.randrange(10), a, b))
    occ = spark.createDataFrame(r.sample(rows, len(rows)), "sample string, h long, occ long, fp0 long, fp1 long").repartition(3)
    exact = {(x.sample, x.h): x.cnt for x in sample_sketch(occ, cap=cap).collect() if x.sample}
    for pairs in (500, 1 << 20):
        got = {(x.sample, x.h): x.cnt for x in approximate_sketch(occ, 1e-8, cap, pairs).collect() if x.sample}
        assert got == exact
    loose = {(x.sample, x.h): x.cnt for x in approximate_sketch(occ, 0.05, cap).collect() if x.sample}
    assert loose.keys() == exact.keys() and all(loose[k] <= exact[k] for k in exact)
    assert approximate_sketch(occ.limit(0)).count() == 0


def test_the_rate_holds_however_many_filters_there_are():
    r = np.random.default_rng(4)
    known = ScalableFilter(1e-8, 4)
    known.add(np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64)))
    assert len(known.filters) > 6
    assert sum(2 * SLOTS * 0.5**f.tag_bits for f in known.filters) <= 1e-8


def number(h, fp):
    """What stands for a k-mer's fingerprint in a filter."""
    return int(_mixed(np.array([h], np.uint64) ^ _mixed(np.array([fp + 1], np.uint64)))[0])


def fingerprint(h, item):
    """The fingerprint that has this number with a k-mer."""
    return int((unmixed(unmixed(np.array([item], np.uint64)) ^ np.uint64(h)) - np.uint64(1)).view(np.int64)[0])


def test_false_positives_change_no_count_of_the_query(spark, monkeypatch):
    rows = []
    for h in range(1000, 1040):
        # Another fingerprint of the k-mer, with the same tag and buckets in the first filter.
        rows += [("s", h, h, 5, 6), ("s", h, h + 10_000, fingerprint(h, number(h, 5) ^ 1 << 20), 7)]
        # Another k-mer's fingerprint, with the same number.
        rows += [("s", 2 * h, h + 20_000, 8, 9), ("s", 2 * h, h + 30_000, fingerprint(2 * h, number(h, 6)), 10)]
        # A duplicate.
        rows += [("s", h, h + 40_000, 7, 11)]
    occ = spark.createDataFrame(rows, "sample string, h long, occ long, fp0 long, fp1 long")
    assert {x.h: x.cnt for x in sample_sketch(occ, cap=4).collect()} == {k * h: 2 for h in range(1000, 1040) for k in (1, 2)}
    monkeypatch.setattr(engine.sk, "read_kmers", lambda *_: occ)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        got = {x.h: x.cnt for x in engine.sample_sketch_approx(spark, DATA).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k * h: 2 for h in range(1000, 1040) for k in (1, 2)}


@pytest.mark.parametrize("expected", [0, 3000, 100_000])
def test_any_expected_number_gives_the_same(spark, expected):
    r = random.Random(7)
    rows = [(r.choice("st"), r.randrange(400), i, *r.choice([(None, None), (r.randrange(9), r.randrange(9))])) for i in range(3000)]
    occ = spark.createDataFrame(rows, "sample string, h long, occ long, fp0 long, fp1 long")
    got = approximate_sketch(occ, 0.01, 4, 1000, exact=True, expected=expected)
    assert {(x.sample, x.h): x.cnt for x in got.collect()} == {(x.sample, x.h): x.cnt for x in sample_sketch(occ, cap=4).collect()}


@pytest.mark.parametrize("cap", [None, 1, 4])
def test_checked_counts_follow_the_rule_with_any_filter(cap):
    r = random.Random(6)
    rows = []
    for _ in range(20_000):
        a, b = r.choice([(None, None), (r.randrange(60), r.randrange(60)), (r.randrange(60), 60), (7, 7)])
        rows.append((int(r.paretovariate(0.4)) % 700, a, b))
    want, flags, seen = {}, {}, set()
    for h, a, b in rows:
        new = a is None or (a != b and (h, a) not in seen and (h, b) not in seen)
        over = cap is not None and flags.get(h, 0) >= cap
        want[h] = want.get(h, 0) + (h not in want or over or new)
        flags[h] = flags.get(h, 0) + (h not in flags or new)
        if a is not None:
            seen |= {(h, a), (h, b)}
    known, pairs, counts, at = ScalableFilter(0.5, 4), cuckoo.Pairs(), {}, 0
    while at < len(rows):
        part = rows[at : at + r.choice([1, 2, 50, 900])]
        h = np.array([x[0] for x in part], np.int64)
        fps = [np.ma.array([x[i] or 0 for x in part], np.int64, mask=[x[i] is None for x in part]) for i in (1, 2)]
        cuckoo.suppressed(h, *fps, known, counts, cap, pairs)
        at += len(part)
    assert {h: n for h, (n, _) in counts.items()} == want
    assert all(len(a[0]) > 2 * len(b[0]) for a, b in zip(pairs.runs, pairs.runs[1:]))
