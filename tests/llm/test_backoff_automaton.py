import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import DATA
from edge import no_documents, odd_documents

from kelpwood.llm import backoff_automaton
from kelpwood.llm.backoff_automaton import discounts, lm_scores, pack, unpack


class PlainModel:
    """The same model with a dictionary of counts for each order."""

    def __init__(self, rows, order):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        for i, text in rows:
            if not held(i):
                t = tokens(text)
                for k in range(1, order + 1):
                    self.counts[k].update(tuple(t[a : a + k]) for a in range(len(t) - k + 1))
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.cuts = [None, None, *(discounts(*(sum(c == x for c in self.counts[k].values()) for x in (1, 2, 3, 4))) for k in range(2, order + 1))]
        self.after = Counter()
        for k in range(2, order + 1):
            for g, c in self.counts[k].items():
                self.after[g[:-1]] += self.cuts[k][min(c, 3) - 1]

    def p(self, context, word):
        if not context:
            return (self.counts[1][(word,)] + 0.1) / (self.n + 0.1 * (self.v + 1))
        k, lower = len(context) + 1, self.p(context[1:], word)
        total = self.counts[k - 1][context]
        if not total:
            return lower
        c = self.counts[k][(*context, word)]
        cut = self.cuts[k][min(c, 3) - 1] if c else 0
        return (c - cut) / total + self.after[context] / total * lower

    def row(self, i, text):
        t = tokens(text)
        score = sum(math.log10(self.p(tuple(t[max(0, a - self.order + 1) : a]), w)) for a, w in enumerate(t))
        return held(i), len(t), sum(self.counts[1][(w,)] > 0 for w in t), self.n, sum(math.log10(self.p((), w)) for w in t), score


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), None]


def same(got, rows, order):
    model = PlainModel(rows, order)
    key = lambda r: [(-1 if x is None else x) for x in r]
    mine = sorted(key(tuple(r)) for r in got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())
    want = sorted(key((i, *model.row(i, t))) for i, t in rows)
    assert len(mine) == len(want)
    for a, b in zip(mine, want):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_plain_counts(spark, monkeypatch, order):
    r = random.Random(order)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(400)]
    rows = [(i, " ".join(r.choice(words).upper() if r.random() < 0.1 else r.choice(words) for _ in range(r.randrange(0, 60)))) for i in range(300)]
    monkeypatch.setattr(backoff_automaton, "RANGE_TOKENS", 300)  # many ranges, and contexts that are spread over them
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(lm_scores(docs, order), rows, order)


def test_real_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    same(lm_scores(docs), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 2)


def test_held_out_texts_gain(spark):
    r = lm_scores(spark.read.parquet(f"{DATA}/documents.parquet")).filter("held_out").groupBy().sum("base_score", "score").first()
    assert r[1] > r[0]


def test_probabilities_sum_to_one():
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcde") for _ in range(20))) for i in range(20)]
    model = PlainModel(rows, 3)
    for context in [(), (b"a",), (b"a", b"b"), (b"e", b"e"), (b"zz",)]:
        total = sum(model.p(context, w[0]) for w in model.counts[1]) + model.p(context, b"unseen")
        assert total == pytest.approx(1)


def test_odd_and_empty_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents(spark).select("doc_id", "text").collect()]
    same(lm_scores(odd_documents(spark)), rows, 2)
    assert lm_scores(no_documents(spark)).count() == 0
    alone = [i for i in range(200) if held(i)][:3]
    rows = [(i, "nothing is learned") for i in alone]
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(0, 0, 0.0, 0.0)}


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_packed_numbers(n):
    x = np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n)
    assert (unpack(pack(x)) == x).all()
    x.sort()
    assert (unpack(pack(x, True), True) == x).all()
