"""Quality, toxicity and language: held-out accuracy and odd tables."""

import zlib

import pytest
from edge import labels, no_documents, odd_documents
from plain import plain_grams, plain_scores, plain_shape, plain_toxic
from pyspark.sql import functions as F

from kelpwood.llm import language, quality, queries, toxicity
from kelpwood.llm.sampling import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def known(spark):
    rows = spark.read.parquet(f"{SF}/labels.parquet").collect()
    return {r.doc_id: (r.quality, r.toxic) for r in rows}


def out_of_fold(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_keeps_good_documents(spark, known):
    got = queries.op2_quality_bayes(spark, SF).collect()
    assert len(got) == 1000 and all(0 <= r.quality_score <= 1 for r in got)
    held = [(r.predicted, known[r.doc_id][0]) for r in got if r.doc_id in known and out_of_fold(r.doc_id)]
    good = [p for p, y in held if y == 1]
    bad = [p for p, y in held if y == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_toxicity_learns_and_holds_out(spark, known):
    got = {r.doc_id: r for r in queries.op7_toxicity_ftrl(spark, SF).collect()}
    assert len(got) == 1000
    assert all(r.held_out == out_of_fold(i) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    clean = [got[i].predicted for i, (_, t) in known.items() if t == 0 and out_of_fold(i)]
    seen = [got[i].predicted for i, (_, t) in known.items() if t == 1 and not out_of_fold(i)]
    assert sum(clean) <= 0.05 * len(clean) and sum(seen) >= 0.5 * len(seen)


def test_toxicity_on_more_labels(spark):
    """Held-out recall needs the words to occur in the sample: four thousand labels."""
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.predicted, toxic[r.doc_id]) for r in queries.op7_toxicity_ftrl(spark, sf).filter("held_out").collect() if r.doc_id in toxic]
    hit = [p for p, y in got if y == 1]
    wrong = [p for p, y in got if y == 0]
    assert sum(hit) >= 0.9 * len(hit) and sum(wrong) <= 0.01 * len(wrong)


def test_ftrl_by_the_formula():
    import numpy as np

    m = toxicity.Ftrl(4, alpha=0.5, beta=1.0, l1=0.1, l2=1.0)
    z, n = [0.0] * 16, [0.0] * 16
    for at, y in (([0, 3], 1), ([0, 5], 0), ([3], 1), ([0, 3, 5], 0)):
        w = {i: 0.0 if abs(z[i]) <= 0.1 else -(z[i] - np.sign(z[i]) * 0.1) / ((1 + n[i] ** 0.5) / 0.5 + 1.0) for i in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in at:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w[i]
            n[i] += g * g
        m.learn(np.array(at), y)
    assert np.allclose(m.z, z) and np.allclose(m.n, n)


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op8_language_bloom(spark, SF).collect()
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert len(got) == 1000 and sum(held) >= 0.98 * len(held)


def test_grams_by_a_plain_rule():
    import numpy as np

    from kelpwood.llm import bytes_text as B

    texts = ["Ab,  cd", "", "x", "éa"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    row, h = language.gram_hashes(data, offsets)
    want = []
    for i, t in enumerate([" ab cd ", "", " x ", " éa "]):
        b = np.frombuffer(t.encode(), np.uint8)
        for k in range(len(b) - 3):
            want.append((i, int(B.range_hashes(b[k : k + 4], np.array([0]), np.array([4]))[0])))
    assert sorted(zip(row.tolist(), h.tolist())) == sorted(want)


def test_bit_slices_hold_every_gram_of_their_language(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma delta" if i % 2 else "uno dos tres cuatro", "en" if i % 2 else "es") for i in range(40)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model["languages"] == ["en", "es"] and all(0 < f < 0.01 for f in model["false_positives"])
    got = {r.lang: r.lang_pred for r in language.identify(docs, model).collect()}
    assert got == {"en": "en", "es": "es"}


def test_language_model_and_scores_equal_a_plain_version(spark):
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    rows = [r for r in docs.collect()]
    bits, least_share = 14, 0.02
    model = language.fit(docs, bits=bits, least_share=least_share)
    learned = [r for r in rows if r.lang is not None and not out_of_fold(r.doc_id)]
    languages = sorted({r.lang for r in learned})
    table = [0] * (1 << bits)
    spots = lambda h: [(h + k * (h >> 32 | 1)) % (1 << bits) for k in range(2)]
    for k, lang in enumerate(languages):
        texts = [set(plain_grams(r.text)) for r in learned if r.lang == lang]
        for h in set().union(*texts):
            if sum(h in t for t in texts) >= max(min(2, len(texts)), least_share * len(texts)):
                for s in spots(h):
                    table[s] |= 1 << k
    assert model["languages"] == languages and model["masks"][0].tolist() == table
    fp = [(sum(x >> k & 1 for x in table) / len(table)) ** 2 for k in range(len(languages))]
    assert model["false_positives"] == pytest.approx(fp)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model, bits=bits).collect()}
    for r in rows:
        grams = plain_grams(r.text)
        both = [table[spots(h)[0]] & table[spots(h)[1]] for h in grams]
        true = [max(0, (sum(m >> k & 1 for m in both) - len(grams) * fp[k]) / (1 - fp[k])) for k in range(len(languages))]
        best = int(np.argmax(true))
        want = (languages[best], min(1, true[best] / max(1, len(grams)))) if any(c.isalpha() for c in r.text or "") else ("und", 0.0)
        assert got[r.doc_id] == (want[0], pytest.approx(want[1], abs=1e-12))


def test_a_language_of_one_text_and_rare_grams(spark):
    rows = [(4 * i, "alpha beta gamma delta", "en") for i in range(20)] + [(1, "quick brown foxes", "en"), (3, "zwei kleine pferde", "de")]
    rows = [r for r in rows if not out_of_fold(r[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.text: (r.lang_pred, r.score) for r in language.identify(docs, language.fit(docs)).collect()}
    assert got["zwei kleine pferde"][0] == "de" and got["zwei kleine pferde"][1] > 0.9
    assert got["quick brown foxes"][1] < 0.2  # in one text of a language that has more: not in its filter
    assert language.fit(docs, least_share=1.0)["languages"] == ["de", "en"]
    strict = {r.text: r.score for r in language.identify(docs, language.fit(docs, least_share=1.0)).collect()}
    assert strict["alpha beta gamma delta"] < 0.1  # in nearly all of the texts is not enough


def test_toxicity_scores_equal_a_plain_version(spark):
    import math

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    weights = toxicity.fit(docs, lab)
    weight = dict(zip(*weights))
    assert weight and all(weight.values())
    for r in toxicity.score(docs, weights).collect():
        z = sum(weight.get(c, 0.0) for c in plain_toxic(r.text or ""))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, z)))), abs=1e-5)


def test_long_texts_in_segments_equal_whole_ones(monkeypatch):
    import random

    import numpy as np

    from kelpwood.llm import bytes_text as B

    r = random.Random(6)
    texts = [" ".join(r.choice(["Alpha", "b", "cc", "12", "Gamma!", "é", "x-y", "\n", "longerword", "longerword"]) for _ in range(n)) for n in (1, 3, 400)] + ["a" * 300, " " * 300, "--" * 200, ""]
    whole = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        _, h = language.gram_hashes(data, np.array([0, len(data)]))
        whole.append((quality.shape_features(data, np.array([0, len(data)])), toxicity.text_features(t), sorted(h.tolist())))
    segments = B.segments
    monkeypatch.setattr(B, "segments", lambda data, member, size=0: segments(data, member, 40))
    monkeypatch.setattr(B, "BLOCK_BYTES", 20)
    for t, (shape, coordinates, grams) in zip(texts, whole):
        data = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(quality.shape_features(data, np.array([0, len(data)])), shape)
        assert toxicity.text_features(t).tolist() == coordinates.tolist()
        counts = {}
        for h, sign in language.text_gram_hashes(data):
            for x in h.tolist():
                counts[x] = counts.get(x, 0) + sign
        assert sorted(x for x, n in counts.items() for _ in range(n)) == grams and min(counts.values(), default=0) >= 0


def test_a_text_of_many_megabytes(spark):
    docs = spark.createDataFrame([(1, "Some words 12, " * 2_000_000, "en")], "doc_id long, text string, lang string")
    some = labels(spark, [(1, 1, 0)])
    assert language.identify(docs, language.fit(docs)).first().lang_pred in ("en", "und")
    assert quality.quality(docs.withColumn("source", F.lit("s")), some, columns=["doc_id"]).count() == 1
    assert toxicity.toxicity(docs, some).select("doc_id", "score").count() == 1


def test_only_coordinates_of_enough_texts_enter_a_model(spark):
    rows = [(4 * i, f"common words {'slur' if i % 2 else 'nice'} rare{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int("slur" in t)) for i, t in rows], "doc_id long, toxic int")
    sizes = [len(toxicity.fit(docs, lab, least_texts=n)[0]) for n in (1, 4, 1000)]
    assert sizes[0] >= sizes[1] > sizes[2] <= 1


def test_many_languages(spark):
    import hashlib

    words = lambda k: " ".join(hashlib.md5(f"{k}/{j}".encode()).hexdigest()[:6] for j in range(12))
    docs = spark.createDataFrame([(i * 100 + k, words(k), f"l{k:03d}") for k in range(70) for i in range(6)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model["masks"]) == 2
    got = language.identify(docs, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) == len(got)


def test_odd_documents(spark):
    docs, none = odd_documents(spark), no_documents(spark)
    some = labels(spark, [(1, 1, 0), (6, 0, 1), (6, None, None), (None, 1, 1), (9, 0, 0), (9, 1, 1)])
    for lab in (some, labels(spark)):
        q = quality.quality(docs, lab)
        assert q.count() == docs.count() and set(docs.columns) <= set(q.columns)
        assert quality.quality(none, lab).count() == 0 and quality.drop_low_quality(docs, lab).columns == docs.columns
        t = toxicity.toxicity(docs, lab)
        assert t.count() == docs.count() and t.filter("score is null or score < 0 or score > 1").count() == 0
        assert toxicity.toxicity(none, lab).count() == 0 and toxicity.drop_toxic(docs, lab).columns == docs.columns
    assert {r.score for r in toxicity.toxicity(docs, labels(spark)).collect()} == {0.5}
    model = language.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert got[3] == got[4] == got[5] == got[9] == ("und", 0.0) and got[7][0] != "und"
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(none)).collect()} == {"und"}


def test_quality_scores_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    weights, odds = quality.fit(docs, lab)
    got = quality.quality(docs, lab).collect()
    assert [r.evidence for r in got] == [pytest.approx(max(-20, min(20, sum(w * x for w, x in zip(weights, plain_shape(r.text))))), abs=1e-9) for r in got]
    want = plain_scores([(r.host, r.path, r.evidence) for r in got], odds)
    assert [(r.site_prior, r.quality_score) for r in got] == [pytest.approx(w, rel=1e-9) for w in want]
    assert all(r.host == (r.source or "") and r.path == (r.lang or "") for r in got)


def test_priors_of_sparse_sites_and_priors_that_decide(spark):
    """Documents of equal evidence: their site decides; one alone at its path has its host's share, one alone at its host the global one."""
    good, bad, middle = 4.0, -4.0, 0.0
    rows = [("a", f"x{k % 4}", good) for k in range(60)] + [("b", f"y{k % 4}", bad) for k in range(60)]
    rows += [("a", "alone", middle), ("b", "alone", middle), ("c", "alone", middle), ("a", "x0", middle), ("b", "y0", middle)]
    df = spark.createDataFrame([(h, p, 1 / (1 + 2.718281828459045**-e)) for h, p, e in rows], "host string, path string, p double")
    sites, found = quality.site_posteriors(df)
    priors = df.join(sites, ["host", "path"]).withColumn("site", F.struct(*sites.columns)).select("host", "path", "p", quality.prior_without(F.col("site"), F.col("p"), found).alias("prior")).collect()
    got = {(r.host, r.path): r.prior for r in priors if abs(r.p - 0.5) < 1e-9}
    want = {r[:2]: s for r, (s, _) in zip(rows, plain_scores(rows, 0.0)) if r[2] == middle}
    assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}
    assert got["a", "alone"] > 0.8 > 0.2 > got["b", "alone"] and 0.3 < got["c", "alone"] < 0.7 and got["a", "x0"] > 0.8 and got["b", "y0"] < 0.2


def test_clashing_columns(spark):
    docs = odd_documents(spark).withColumnsRenamed({"kept": "_site", "fingerprint": "evidence_"})
    some = labels(spark, [(1, 1, 0), (6, 0, 1), (9, 0, 0)])
    assert quality.quality(docs, some).count() == docs.count()
    assert quality.drop_low_quality(docs, some).columns == docs.columns


def test_folds(spark):
    df = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == out_of_fold(r.id) for r in df)
