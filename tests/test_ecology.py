import numpy as np
import pytest

from kelpwood.operators import ecology as ec


def test_coordinates_keep_euclidean_distances():
    x = np.random.default_rng(1).normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    p, explained = ec.principal_coordinates(d)
    assert np.allclose(np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)), d) and explained.sum() == pytest.approx(1)


def test_clusters_and_their_number():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(c, 0.05, size=(10, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    k, labels, score = ec.auto_k(x)
    assert k == 3 and score > 0.9 and len({tuple(labels[i : i + 10]) for i in (0, 10, 20)}) == 3


def test_linkage_puts_like_next_to_like():
    x = np.array([[0.0], [10.0], [0.1], [10.1], [0.2]])
    order = ec.linkage_order(np.abs(x - x.T))
    assert {frozenset(order[:3]), frozenset(order[3:])} == {frozenset({0, 2, 4}), frozenset({1, 3})} or {frozenset(order[:2]), frozenset(order[2:])} == {frozenset({0, 2, 4}), frozenset({1, 3})}
    assert ec.linkage_order(np.zeros((2, 2))) == [0, 1]


def table(spark, rows):
    return spark.createDataFrame(rows, "sample string, taxon string, value double")


def test_distances_of_equal_and_unlike_samples(spark):
    df = table(spark, [("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 1.0), ("b", "y", 3.0), ("c", "x", 4.0)])
    bray = {(r.s1, r.s2): r.d for r in ec.bray_curtis(df).collect()}
    assert bray["a", "b"] == pytest.approx(0) and bray["a", "c"] == pytest.approx(1 - 2 / 8)
    assert {(r.s1, r.s2): r.d for r in ec.euclidean(df).collect()}["a", "c"] == pytest.approx(np.sqrt(9 + 9))


def test_a_constant_taxon_is_uncorrelated(spark):
    df = table(spark, [("a", "x", 1.0), ("b", "x", 1.0), ("a", "y", 1.0), ("b", "y", 2.0), ("a", "z", 2.0), ("b", "z", 4.0)])
    d = {(r.t1, r.t2): r.d for r in ec.taxon_correlation(df, 2).collect()}
    assert d["x", "y"] == 1 and d["y", "z"] == pytest.approx(0)


def test_empty_tables(spark):
    df = table(spark, [])
    for out in (ec.alpha_diversity(df), ec.bray_curtis(df), ec.nearest(ec.bray_curtis(df)), ec.gower_center(ec.bray_curtis(df)), ec.ordination(spark, ec.bray_curtis(df))):
        assert out.count() == 0


def test_markers_too_few_or_even(spark):
    df = table(spark, [("a", "x", 1.0), ("b", "x", 50.0), ("b", "y", 45.0), ("c", "x", 90.0), ("c", "y", 1.0)])
    got = {r["sample"]: r.call for r in ec.marker_split(df, {"X": ["x"], "Y": ["y"]}).collect()}
    assert got == {"a": "", "b": "between", "c": "X"}


def brute_pairs(rows):
    """Distances of all pairs of samples, and correlations of all pairs of taxa, from the full table."""
    samples, taxa = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.zeros((len(samples), len(taxa)))
    for s, t, v in rows:
        x[samples.index(s), taxa.index(t)] = v
    bray, euclid, corr = {}, {}, {}
    for i, a in enumerate(samples):
        for j in range(i + 1, len(samples)):
            total = x[i].sum() + x[j].sum()
            bray[a, samples[j]] = 1 - 2 * np.minimum(x[i], x[j]).sum() / total if total else 0
            euclid[a, samples[j]] = np.sqrt(((x[i] - x[j]) ** 2).sum())
    for i, a in enumerate(taxa):
        for j in range(i + 1, len(taxa)):
            flat = x[:, i].std() < 1e-6 or x[:, j].std() < 1e-6
            corr[a, taxa[j]] = 1 if flat else 1 - np.corrcoef(x[:, i], x[:, j])[0, 1]
    return samples, bray, euclid, corr


def test_pairs_that_share_nothing(spark):
    rows = [("a", "t1", 2.0), ("b", "t2", 3.0), ("c", "t1", 1.0), ("c", "t2", 1.0), ("d", "t3", 4.0), ("e", "t3", 1.0), ("e", "t1", 1.0), ("f", "t4", 2.0)]
    df = table(spark, rows)
    samples, bray, euclid, corr = brute_pairs(rows)
    got = ec.bray_curtis(df)
    assert {(r.s1, r.s2): r.d for r in got.collect()} == pytest.approx(bray) and bray["a", "b"] == 1
    assert {(r.s1, r.s2): r.d for r in ec.euclidean(df).collect()} == pytest.approx(euclid) and euclid["a", "b"] == pytest.approx(np.sqrt(13))
    assert {(r.t1, r.t2): r.d for r in ec.taxon_correlation(df, len(samples)).collect()} == pytest.approx(corr)
    n = len(samples)
    d = np.zeros((n, n))
    for (a, b), v in bray.items():
        d[samples.index(a), samples.index(b)] = d[samples.index(b), samples.index(a)] = v
    c = np.eye(n) - 1 / n
    want = c @ (-(d**2) / 2) @ c
    assert {(r.s1, r.s2): r.b for r in ec.gower_center(got).collect()} == pytest.approx({(a, b): want[i, j] for i, a in enumerate(samples) for j, b in enumerate(samples) if i != j})
    near = {(r["sample"], r.place): r.neighbour for r in ec.nearest(got, 5).collect()}
    assert near == {(a, k + 1): b for a in samples for k, b in enumerate(sorted((s for s in samples if s != a), key=lambda s: (round(d[samples.index(a), samples.index(s)], 12), s)))}
    cluster = {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "f": 2}
    labels = np.array([cluster[s] for s in samples])
    sil = {r["sample"]: r.s for r in ec.silhouettes(got, spark.createDataFrame(list(cluster.items()), "sample string, cluster int")).collect()}
    for i, s in enumerate(samples):
        own = (labels == labels[i]) & (np.arange(n) != i)
        a, b = (d[i, own].mean(), min(d[i, labels == k].mean() for k in range(3) if k != labels[i])) if own.any() else (0, 0)
        assert sil[s] == pytest.approx((b - a) / max(a, b) if own.any() else 0)
    names, square = ec.square(got)
    assert names == samples and np.allclose(square, d)


def test_few_samples_and_bounds(spark, monkeypatch):
    assert ec.auto_k(np.zeros((2, 2)))[0] == 1 and ec.auto_k(np.zeros((0, 2)))[1].tolist() == []
    monkeypatch.setattr(ec, "MOST_SAMPLES", 2)
    with pytest.raises(ValueError, match="3 samples"):
        ec.bray_curtis(table(spark, [("a", "x", 1.0), ("b", "x", 1.0), ("c", "x", 1.0)]))


def test_ranks_over_ranges(spark):
    r = np.random.default_rng(3)
    values = r.integers(0, 50, 500).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long").repartition(7)
    got = {x.id: x.place for x in ec.global_rank(df, "v", "id", name="place").collect()}
    assert got == {i: k + 1 for k, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    alpha = spark.createDataFrame([("a", 2.0), ("b", 5.0), ("c", 5.0), ("d", 1.0)], "sample string, effective double")
    assert {x["sample"]: x.place for x in ec.diversity_rank(alpha).collect()} == {"b": 1, "c": 1, "a": 3, "d": 4}


def test_identity_deltas(spark):
    rows = lambda off: spark.createDataFrame([(i, 90.0 + i * off) for i in range(6)], "taxon int, ani double")
    got = ec.identity_deltas(rows(0), rows(0.5).filter("taxon > 0")).first()
    assert (got.n, got.median, got.least, got.most) == (5, 1.5, 0.5, 2.5)
