import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge import SCHEMA, no_documents, odd_documents

from kelpwood.llm import pair_bitmaps
from kelpwood.llm.pair_bitmaps import Aligner, align_tokenizers, bitmaps, byte_level, chunks, index, pair_table, segments
from kelpwood.llm.queries import tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_alignment(libraries, texts):
    """Rows of the contract, whole texts at a time, with sets of byte offsets."""
    a, b = libraries
    chars = byte_level()
    a_bytes = lambda i: bytes(chars[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, count = [], Counter()
    for text in texts:
        links, groups, ia, ib = Counter(), [], [], []
        if text and "▁" not in text:  # such texts have no tokens
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((a_bytes, ia), (b_bytes, ib))]
            if b"".join(map(a_bytes, ia)) == b"".join(map(b_bytes, ib)) == (" " + text).encode():
                both, i, j = sorted(set(ends[0]) & set(ends[1])), 0, 0
                for e in both:
                    xs = [x for x, at in zip(ia[i : i + 300], ends[0][i : i + 300]) if at <= e]
                    ys = [x for x, at in zip(ib[j : j + 300], ends[1][j : j + 300]) if at <= e]
                    i, j = i + len(xs), j + len(ys)
                    groups.append((xs, ys))
                    links.update((x, y) for x in xs for y in ys)
            else:
                ia, ib = [], []
        count.update(links.keys())
        sha = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""
        docs.append((len(ia), len(ib), len(groups), sum(links.values()), links, sha))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for na, nb, ng, nl, links, sha in docs:
        out.append((na, nb, ng, nl, sum(t for p, t in links.items() if count[p] == best[p[0]]), sum(t * count[p] for p, t in links.items()), sha))
    return out, count


def odd_texts(seed, n):
    r = random.Random(seed)
    bits = ["the", "Hello", "world", "naïve", "日本語", "\n", "\n\n", " ", "  ", "\t", "'s", "don't", "123", "4567", "▁", " ", "　", "\x1c", "\x85", "<|endoftext|>", "<s>", "é", "é", "\U0001f600", "!!!", "--", "…", "\r\n", "x" * 70, "aeiou"]
    return ["".join(r.choice(bits) + (" " if r.random() < 0.5 else "") for _ in range(r.randrange(0, 40))) for _ in range(n)]


def test_chunks_give_the_libraries_tokens(libraries):
    a, b = libraries
    own = Aligner(A, B)
    assert own.by_chunks
    for text in odd_texts(3, 3000):
        if text and "▁" not in text:  # such texts have no tokens
            cs = [c for part in own.split(text) for c in part]
            assert "".join(" " + c for c in cs) == " " + text
            ids = [e.ids for e in a.encode_batch([" " + c for c in cs], add_special_tokens=False)]
            assert sum(ids, []) == a.encode(" " + text, add_special_tokens=False).ids, text
            assert sum(b.encode(cs), []) == b.encode(text), text


def test_segments():
    text = "ab cd  ef\n gh " * 500
    parts = list(segments(text, 100))
    assert len(parts) > 10 and " ".join(parts) == text
    assert [c for p in parts for c in chunks(p)] == chunks(text)


@pytest.mark.parametrize("n_docs", [5, 100, 40_000])
def test_bitmaps_round_trip(n_docs):
    r = np.random.default_rng(n_docs)
    key = np.unique(r.integers(0, 30, 3000) * n_docs + (r.random(3000) ** 3 * n_docs).astype(np.int64))
    pair, doc, times = key // n_docs, key % n_docs, r.integers(1, 20, len(key))
    got = defaultdict(int)
    for p, plane, n, dense, binary in bitmaps(pair, doc, times, n_docs):
        for p, plane, n, dense, x in zip(p.to_pylist(), plane.to_pylist(), n.to_pylist(), dense.to_pylist(), binary.to_pylist()):
            places = np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))) if dense else np.frombuffer(x, "<u2")
            assert len(places) == n
            for d in places:
                got[p, int(d)] += 1 << max(plane - 1, 0)
    assert got == {(int(p), int(d)): int(t) for p, d, t in zip(pair, doc, times)}


def test_equals_whole_texts(spark, libraries, monkeypatch):
    texts = odd_texts(5, 300) + [None, "", "a", "one " * 3000, "the cat " * 40] + ["the same words again"] * 30
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want, count = plain_alignment(libraries, texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in align_tokenizers(docs, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert [got[i] for i in range(len(texts))] == want
    rows = pair_table(index(docs, A, B).filter("pair is not null")).collect()
    assert {(r["a"], r["b"]): r["docs"] for r in rows} == count


def test_odd_and_empty_tables(spark, libraries):
    rows = odd_documents(spark).select("doc_id", "text").collect()
    want, _ = plain_alignment(libraries, [r["text"] for r in rows])
    got = align_tokenizers(odd_documents(spark), A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got)) == sorted(key((r["doc_id"], *w)) for r, w in zip(rows, want))
    assert align_tokenizers(no_documents(spark), A, B).count() == 0
    assert SCHEMA and pair_bitmaps.BLOCK_DOCS <= 1 << 16
