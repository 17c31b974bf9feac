"""Plain versions of what the operators compute, one text at a time."""

import math
import re
from collections import defaultdict
from functools import cache

import numpy as np

from kelpwood.llm import bytes_text as B

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@cache
def word_hash(b):
    return int(B.range_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])


@cache
def mixed(x):
    return int(B.mixed(np.array([x % (1 << 64)], np.uint64))[0])


def plain_shape(text):
    """Quality's features of a text."""
    b = (text or "").encode()
    words = [w.lower() for w in b.split()]
    n = max(1, len(words))
    count = lambda chars: sum(b.count(c.encode()) for c in chars)
    small, large = count("abcdefghijklmnopqrstuvwxyz"), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    again = sum(x == y for x, y in zip(words, words[1:]))
    few = max(0, 0.6 - len(set(words)) / n) if words else 0
    return [1, math.log1p(len(words)), large / max(1, small + large), min(2, count("#$%&*+<=>@[\\]^_`{|}~") / n), min(2, count("!?.,;:-'\"()/") / n), min(2, count("0123456789") / n), again / n, few, min(20, len(b) / n) / 10]


def plain_toxic(text):
    """Toxicity's coordinates of a text, the bias among them."""
    words = WORD.findall(text.encode().lower())
    h = [word_hash(w) for w in words]
    found = set(h) | {mixed(word_hash(w[:k]) + k) for w in set(words) for k in (5, 6, 7, 8) if len(w) > k}
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        found |= {mixed((a * salt + b) % (1 << 64)) for a, b in set(zip(h, h[gap:]))}
    return {c if (c := x >> 44) else 1 for x in found} | {0}


def plain_grams(text):
    """Hashes of the 4-byte n-grams of one text, with repeats, word by word."""
    words = WORD.findall((text or "").encode().lower())
    b = np.frombuffer(b" " + b" ".join(words) + b" " if words else b"", np.uint8)
    return [int(B.range_hashes(b[k : k + 4], np.array([0]), np.array([4]))[0]) for k in range(len(b) - 3)]


def plain_scores(rows, odds):
    """rows: (host, path, evidence) to (prior, posterior), by sums over lists."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    p = [sig(e + odds) for *_, e in rows]
    path, host = defaultdict(list), defaultdict(list)
    for (h, q, _), x in zip(rows, p):
        path[h, q].append(x)
        host[h].append(x)
    n, good = len(p), sum(p)
    share = (good + 1) / (n + 2)

    def strength(groups):  # (sum, count, parent's share)
        spread = sum((g - c * s) ** 2 / c for g, c, s in groups)
        noise = sum(s * (1 - s) for _, _, s in groups)
        gain = sum(s * (1 - s) * (c - 1) for _, c, s in groups)
        rho = min(0.5, max(1e-4, (spread - noise) / gain)) if gain else 0.5
        return (1 - rho) / rho

    mh = strength([(sum(x), len(x), share) for x in host.values()])
    of_host = {h: (sum(x) + mh * share) / (len(x) + mh) for h, x in host.items()}
    mp = strength([(sum(x), len(x), of_host[h]) for (h, _), x in path.items()])
    out = []
    for (h, q, e), x in zip(rows, p):
        g = (good - x + 1) / (n + 1)
        s = (sum(host[h]) - x + mh * g) / (len(host[h]) - 1 + mh)
        s = (sum(path[h, q]) - x + mp * s) / (len(path[h, q]) - 1 + mp)
        s = min(1 - 1e-6, max(1e-6, s))
        out.append((s, sig(e + math.log(s / (1 - s)))))
    return out
