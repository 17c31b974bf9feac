from kelpwood.llm.bpe_pieces import PieceCodec
from kelpwood.llm.lately import Lately
from kelpwood.llm.queries import tokenizer
from kelpwood.llm.word_tokens import WordTokens


def test_values_are_made_once_and_memory_is_bounded():
    made = []

    def make(xs):
        made.extend(xs)
        return [x.encode() for x in xs]

    known = Lately(most=200_000, longest=10)
    for k in range(300):
        wanted = {f"w{i}" for i in range(k * 20, k * 20 + 40)} | {"y" * 500}
        got = known.look_up(wanted, make)
        assert all(got[x] == x.encode() for x in wanted)
    assert len(known.young) + len(known.old) < 200_000 / 150 + 100
    assert made.count("w100") == 1 and made.count("y" * 500) == 300
    known.look_up(set(), make)
    assert "y" * 500 not in known.young


def test_unspaced_texts_are_not_kept():
    import random

    r = random.Random(1)
    texts = ["".join(chr(r.randrange(0x4E00, 0x6E00)) for _ in range(1000)) for _ in range(300)]
    words, pieces = WordTokens(tokenizer("word_bpe_49k.json")), PieceCodec(tokenizer("piece_bpe_32k.model"))
    assert words.encode(texts) == words._packed(texts)
    found = pieces.summaries(texts)
    assert [f[0] for f in found[:5]] == [len(x) for x in pieces.library.encode(texts[:5])]
    for known in (words.known, pieces.words):
        known.look_up(set(), lambda xs: xs)
        assert not known.young and not known.old


def test_joined_runs_equal_the_library():
    import random

    r = random.Random(4)
    bits = ["the", "It's", "'s", "'", "'sx", "12", "a1b", "é", "É", "ß", "日本", "\x1c", "\x00", "  ", "\n", "--", "!?", "x" * 80, "don't", "'RE", " ", "ﬁ", "İ", "<|endoftext|>"]
    own = WordTokens(tokenizer("word_bpe_49k.json"))
    texts = ["".join(r.choice(bits) + " " * r.randrange(2) for _ in range(r.randrange(30))) for _ in range(2000)]
    assert own.encode(texts) == own._packed(texts)
