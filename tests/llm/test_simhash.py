import random

import numpy as np
import pytest
import xxhash
from edge import no_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as hs

from kelpwood.llm.components import components
from kelpwood.llm.simhash import drop_near_duplicates, near_duplicates, similar_edges, text_fingerprint, trie_components, trie_links


def slow_fingerprint(text, n=4):
    words = text.encode("utf-8", "surrogatepass").lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hs_ = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs_) > len(hs_))


def brute_labels(fps, budget=4):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(fps))]


def clustered(r, n, flips):
    """Random centres with near copies, and some chains."""
    out = set()
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 30)):
            for _ in range(r.randrange(flips)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    return sorted(out)[:n]


@given(hs.text(alphabet="aAbB \t\n\x1cé日", max_size=80))
@settings(max_examples=200, deadline=None)
def test_fingerprints(text):
    assert text_fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("flips", [3, 6, 10])
def test_trie_join_equals_brute_force(flips):
    r = random.Random(flips)
    fps = clustered(r, 400, flips)
    got = trie_components(np.array(fps, np.uint64), [(0, len(fps), 0, len(fps))])
    assert got.tolist() == brute_labels(fps)


@pytest.mark.parametrize("n", [2, 300])
def test_pairs_of_two_ranges(n):
    r = random.Random(n)
    fps = sorted(clustered(r, n, 6))
    half = n // 2
    got = trie_components(np.array(fps, np.uint64), [(0, half, half, n), (0, half, 0, half), (half, n, half, n)])
    assert got.tolist() == brute_labels(fps)


@pytest.mark.parametrize("seed", range(4))
def test_links_within_both_budgets(seed):
    """A forest of the links within the budgets of the word and of all words."""
    r = random.Random(seed)
    fps = clustered(r, 300, 6)
    n = len(fps)
    words = [[x, x ^ sum(1 << r.randrange(64) for _ in range(r.randrange(3)))] for x in fps]
    bits = lambda i, j: sum((a ^ b).bit_count() for a, b in zip(words[i], words[j]))
    links = {(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 6 and bits(i, j) <= 8}

    def labels(pairs):
        label = list(range(n))

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        for i, j in sorted(pairs):
            a, b = sorted((find(i), find(j)))
            label[b] = a
        return [find(i) for i in range(n)]

    got, a, b, d = trie_links(np.array(fps, np.uint64), np.array([[0, n, 0, n]]), 6, np.array(words, np.uint64), 8)
    forest = {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert got.tolist() == labels(links) == labels(forest) and forest <= links and len(forest) == len(a)
    assert d.tolist() == [bits(x, y) for x, y in zip(a.tolist(), b.tolist())]
    assert len(forest) == n - len(set(labels(links)))


@pytest.mark.parametrize(("blocks", "hot"), [(6, 100_000), (7, 100_000), (5, 20), (6, 5)])
def test_edges_connect_all_and_only_links(spark, blocks, hot):
    r = random.Random(9)
    fps = clustered(r, 300, 8) + [(0xABC << 52) | r.getrandbits(20) for _ in range(150)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = similar_edges(df, 4, blocks, hot).collect()
    at = {x: i for i, x in enumerate(fps)}
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for e in edges:
        a, b = sorted((find(at[e.a % (1 << 64)]), find(at[e.b % (1 << 64)])))
        label[b] = a
    assert [find(i) for i in range(len(fps))] == brute_labels(fps)


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(70, 71), (71, 72), (72, 70), (80, 80)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 40)}, 70: 70, 71: 70, 72: 70}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = near_duplicates(docs).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    fps = [slow_fingerprint(t) for _, t in texts]
    label = brute_labels(fps)
    least = {}
    for (i, _), lab in zip(texts, label):
        if i is not None:
            least[lab] = min(least.get(lab, i), i)
    want = sorted(((i, f"{f:016x}", least.get(lab)) for (i, _), f, lab in zip(texts, fps, label)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert near_duplicates(no_documents(spark)).count() == 0
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 6, 7, 8, 9, None}
