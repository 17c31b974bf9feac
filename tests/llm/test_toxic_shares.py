"""Toxic words count at any share of toxic labels."""

import random
import zlib

import pytest

from kelpwood.llm import toxicity


@pytest.mark.parametrize("share", [0.11, 1 / 3, 0.5])
def test_common_toxic_words_are_learned(spark, share):
    r = random.Random(11)
    markers = [f"slur{k}" for k in range(10)]
    rows, known = [], []
    for i in range(1200):
        words = [f"w{min(r.randrange(400), r.randrange(400))}" for _ in range(40)]
        toxic = int(r.random() < share)
        for w in r.sample(markers, 3) if toxic else []:
            words.insert(r.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        known.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(known, "doc_id long, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity.toxicity(docs, labels).collect()}
    held = [(got[i], t) for i, t in known if zlib.crc32(str(i).encode()) % 4 == 2]
    hit = [p for p, t in held if t]
    wrong = [p for p, t in held if not t]
    assert sum(hit) >= 0.9 * len(hit) and sum(wrong) <= 0.05 * len(wrong)
