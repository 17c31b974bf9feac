"""Near copies against brute-force Jaccard over five-word shingles."""

import random

import corpus_pipeline
import numpy as np
import pytest
from edge import no_documents, odd_documents

from kelpwood.llm.similar_texts import drop_similar_texts, similar_texts, shingle_set

SF = "/root/testdata/sf0.01"


def plain_set(text, n=5):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows):
    """The smallest id of each row's component, over all pairs."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 4 * len(sets[i]) <= 5 * len(sets[j]) and 4 * len(sets[j]) <= 5 * len(sets[i]):
                common = len(sets[i] & sets[j])
                if 9 * common >= 4 * (len(sets[i]) + len(sets[j])):
                    a, b = sorted((find(i), find(j)))
                    label[b] = a
    return [rows[find(i)][0] for i in range(len(rows))]


def copies(r, n):
    """Texts of many lengths with chains of changed copies, and a line that many share."""
    line = " ".join(f"line{k}" for k in range(25))
    out = []
    while len(out) < n:
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([1, 3, 6, 9, 14, 30, 80, 300]))] + (line.split() if r.random() < 0.5 else [])
        for _ in range(r.randrange(1, 8)):
            for _ in range(r.randrange(1 + len(words) // 40 + 1)):
                at = r.randrange(len(words))
                words[at : at + r.randrange(2)] = [f"x{r.randrange(10**6)}"] * r.randrange(3)
                words = words or ["x"]
            out.append(" ".join(words))
    return [(100 + i, t) for i, t in enumerate(out[:n])]


def test_stage_equals_brute_force_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()}
    assert got == set(brute(rows))


def test_chains_and_common_lines(spark):
    rows = copies(random.Random(5), 500)
    got = {r.doc_id: r.component_id for r in similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for (i, _), c in zip(rows, brute(rows))}


def step(r, words, n):
    """A copy with n words changed, each in a place of its own."""
    words = list(words)
    for at in r.sample(range(len(words)), n):
        words[at] = f"y{r.randrange(10**9)}"
    return words


def base(r, n=200):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def chains(r):
    """Each text next to the one before at a Jaccard of about 0.86, and far from others."""
    for _ in range(12):
        words = base(r)
        for _ in range(60):
            words = step(r, words, 3)
            yield words


def stars(r):
    """Copies that are near their base and not near each other."""
    for _ in range(6):
        words = base(r)
        yield words
        for _ in range(50):
            yield step(r, words, 4)


def bridges(r):
    """Two groups that only one text of each side connects, or that a text too few leaves apart."""
    for k in range(12):
        words = base(r)
        for n in range(4):
            yield from (step(r, words, 1) for _ in range(8))
            words = step(r, words, 3 if k % 2 or n != 1 else 8)
            yield words


@pytest.mark.parametrize(("kind", "part_sets"), [(chains, 2048), (chains, 20), (stars, 2048), (stars, 13), (bridges, 2048), (bridges, 9)])
def test_chains_stars_and_bridges(spark, kind, part_sets):
    r = random.Random(11)
    rows = [(i, " ".join(w)) for i, w in enumerate(kind(r))]
    want = brute(rows)
    docs = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in similar_texts(docs, part_sets=part_sets).collect()}
    assert [got[i] for i, _ in rows] == want
    if kind is chains:
        assert len(set(want)) == 12


@pytest.mark.parametrize("seed", range(6))
def test_links_of_a_task_equal_brute_force(seed, monkeypatch):
    from kelpwood.llm import similar_texts as m

    if seed % 2:
        monkeypatch.setattr(m, "BIT_ROWS", 0)
    monkeypatch.setattr(m, "CHUNK_COMPARED", 7)
    r = np.random.default_rng(seed)
    sets = []
    for _ in range(12):
        x = r.integers(0, 1 << 40, r.integers(1, 60))
        for _ in range(r.integers(1, 15)):
            x = np.where(r.random(len(x)) < 0.06, r.integers(0, 1 << 40, len(x)), x)
            sets.append(np.unique(x).astype(np.uint64))
    words = np.array([m.wide_fingerprint(s) for s in sets], np.uint64)
    side = r.integers(0, 2, len(sets)) if seed > 2 else np.zeros(len(sets), np.int64)

    def labels(pairs):
        label = list(range(len(sets)))
        for i, j in pairs:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
        return label

    def similar(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9

    budget = m.bit_budget(320, 0.8)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if (side[i] != side[j] or not side.any()) and np.bitwise_count(words[i] ^ words[j]).sum() <= budget and similar(i, j)]
    got = m.similar_links(words, sets, side, budget, 0.8)
    assert labels(got) == labels(links) and len(got) == len(sets) - len(set(labels(links)))
    assert all(similar(i, j) for i, j in got)


def test_budgets_and_fingerprints():
    from kelpwood.llm.similar_texts import bit_budget, wide_fingerprint

    assert bit_budget(64, 1.0) == 0 and bit_budget(64, 0.8) == 22 and bit_budget(320, 0.8) == 75
    r = np.random.default_rng(2)
    both, one, other = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    a, b = (wide_fingerprint(np.unique(np.concatenate([both, x]))) for x in (one, other))
    assert len(a) == 5 and 25 < sum((x ^ y).bit_count() for x, y in zip(a, b)) < 75  # Jaccard 0.8


def test_odd_documents(spark):
    docs = odd_documents(spark)
    kept = drop_similar_texts(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 6, 7, 8, 9, None}
    assert similar_texts(no_documents(spark)).count() == 0
    assert shingle_set("").tolist() == [0]
