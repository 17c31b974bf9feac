import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import DATA, same_result
from edge import no_documents, odd_documents

from kelpwood.llm.ball_tree import SQL, BallTree, ranked_search, search, terms_of
from kelpwood.llm.queries import op11_ball_tree_search


def plain_search(docs, items, k=20):
    """Every document against every item, in whole numbers."""
    terms = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode().lower())
    docs = [(i, c, sum(c.values())) for i, c in ((i, Counter(terms(t))) for i, t in docs) if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        q = Counter(terms(text))
        found = []
        for i, c, n in docs:
            m = 100 - 25 + ((25 * n * n_docs) // n_terms)
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, x in q.items() if c[t])
            if s > 0:
                found.append((-s, math.inf if i is None else i))
        out += [(item, rank, None if i == math.inf else i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_terms():
    assert terms_of("Don't STOP_me: Été 12x") == [b"don", b"t", b"stop", b"me", "Été".encode(), b"12x"]


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_and_search_is_exact(seed):
    r = np.random.default_rng(seed)
    n, width = 700, 40
    counts = r.integers(0, 12, n)
    starts = np.concatenate([[0], np.cumsum(counts)])
    cols = np.concatenate([np.sort(r.choice(width, c, replace=False)) for c in counts]).astype(np.int64)
    impacts = r.integers(1, 10**6, len(cols))
    w = r.integers(0, 20_000, width)
    roots = np.sqrt(w)
    tree = BallTree(starts, cols, impacts * roots[cols], width, leaf=8)
    assert sorted(tree.order.tolist()) == list(range(n))
    dense = np.zeros((n, width), np.int64)
    dense[np.repeat(np.arange(n), counts), cols] = impacts
    place = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in tree.order])
    at = np.concatenate([[0], np.cumsum(counts[tree.order])])
    skipped = 0
    for _ in range(20):
        terms = np.sort(r.choice(width, 5, replace=False))
        weights = w[terms] * r.integers(1, 3, 5)
        scores = dense[:, terms] @ weights
        shared = np.divide(weights, roots[terms], out=np.zeros(5), where=roots[terms] > 0)
        for bound, (a, b, _, _) in zip(tree.bounds(terms, shared), tree.nodes):
            assert scores[tree.order[a:b]].max() <= bound
        best, scored = search(tree, at, cols[place], impacts[place], tree.order * 3, (terms, weights), roots, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 10)
        want = sorted((-s, i * 3) for i, s in enumerate(scores.tolist()) if s > 0)[:10]
        assert [(-s, i) for s, i in zip(*map(np.ndarray.tolist, best))] == want
        skipped += sum(x[2] < 0 for x in tree.nodes) - scored
    assert skipped > 0


def test_equals_brute_force(spark):
    r = random.Random(7)
    words = ["alpha", "Beta", "γάμμα", "delta9", "the", "a", "of", "x"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(r.randrange(0, n)))
    docs = [(i, text(60)) for i in range(400)] + [(1000 + i, "the same of it") for i in range(40)] + [(2000, None), (None, "alpha alpha"), (2001, ""), (2002, "--")]
    items = [(i, text(12)) for i in range(30)] + [(100, "the of"), (101, "unheard word"), (102, None), (103, "w1 " * 50)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(plain_search(docs, items), key=str)
    assert rows_of(ranked_search(d, q)) == want
    assert rows_of(ranked_search(d, q, block=64, batch_bytes=200)) == want


def test_query_equals_sql(spark, duck):
    same_result(op11_ball_tree_search(spark, DATA), duck.sql(SQL))


def test_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([("a", "the cat", 1), ("b", "日本 word", 2), ("c", "other", 3)], "item_id string, text string, doc_id int")
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert rows_of(ranked_search(docs, items)) == sorted(want, key=str)
    assert ranked_search(no_documents(spark), items).count() == 0
    assert ranked_search(docs, items.limit(0)).count() == 0
