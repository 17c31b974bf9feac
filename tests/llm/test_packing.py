import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from edge import no_documents, odd_documents

from kelpwood.llm.packing import best_fit, cut_pieces, pack_documents, pack_pieces
from kelpwood.llm.queries import tokenizer
from kelpwood.llm.word_tokens import WordTokens

PATH = tokenizer("word_bpe_49k.json")


def slow_best_fit(sizes, capacity):
    room, where = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [b for b in range(len(room)) if room[b] >= sizes[i]]
        b = min(fits, key=lambda b: room[b]) if fits else len(room)
        if not fits:
            room.append(capacity)
        room[b] -= sizes[i]
        where[i] = b
    return len(room), sorted(room)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_the_plain_rule(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 100) for _ in range(r.randrange(0, 200))]
    bins, offsets, fills = best_fit(np.array(sizes, np.int64), 100)
    n, rooms = slow_best_fit(sizes, 100)
    assert len(fills) == n and sorted((100 - fills).tolist()) == rooms
    used = defaultdict(list)
    for s, b, o in zip(sizes, bins, offsets):
        used[b].append((o, s))
    for b, parts in used.items():
        at = 0
        for o, s in sorted(parts):
            assert o == at
            at += s
        assert at == fills[b] <= 100


def test_ids_equal_the_library():
    tokens = WordTokens(PATH)
    texts = ["", "it's I'LL we''s 12ab3 x", "a <|endoftext|> b", "Σίσυφος ΟΔΟΣ é É İx ß ǅ ẞ", "a\x1cb\x1d c", "ﬁ ½ ² ª º µ", "é .\u0301 a\u2003b\u00a0c\x85d", "日本語 テスト", "👩‍👩", "\x00 a\x7f", "don't.### 'sx x's", "Straße ÜBER"]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokens.library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.encode(texts) == want and tokens.encode(texts[::-1]) == want[::-1]


def check_sequences(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("parts", [1, 7])
def test_rounds_pack_tightly_and_lose_nothing(spark, parts):
    r = random.Random(parts)
    pieces = [(i, 0, 0, r.choice([r.randint(1, 4096), r.randint(1, 300)]), i) for i in range(3000)]
    df = spark.createDataFrame(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(parts)
    got = pack_pieces(df, per_task=300, fan_in=4).collect()
    assert sorted((x.doc_id, x.length) for x in got) == sorted((p[0], p[3]) for p in pieces)
    assert check_sequences(got, 4096) <= 1.02 * sum(p[3] for p in pieces) / 4096 + 2


@pytest.mark.parametrize("per_task", [1000, 100_000])
def test_an_ordered_table_packs_as_well_as_any(spark, per_task):
    lengths = [2600] * 6000 + [1400] * 6000
    df = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pack_pieces(df, per_task=per_task).collect()
    assert len(got) == 12_000 and check_sequences(got, 4096) <= 6000 * 1.01


def test_long_items_that_join_nothing_are_all_kept(spark):
    pieces = [(i, 0, 0, 2100, i) for i in range(200)]
    df = spark.createDataFrame(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    got = pack_pieces(df, per_task=10, fan_in=2).collect()
    assert len(got) == 200 and check_sequences(got, 4096) == 200


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = pack_documents(docs, PATH).collect()
    check_sequences(got, 4096)
    library = WordTokens(PATH).library
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        want += [(r.doc_id, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got), key=str) == sorted(want, key=str)
    assert pack_documents(no_documents(spark), PATH).count() == 0
    assert cut_pieces(docs, PATH, with_ids=True).filter("doc_id = 8").first().ids[-1] == 1
