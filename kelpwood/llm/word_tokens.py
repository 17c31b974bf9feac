"""Token ids of whole texts by the tokenizers library, one distinct run of characters at a time.

The vocabulary splits at white space, and between letters, digits and other
characters, before it merges anything, so a text's ids are those of its runs
in turn. Each Python worker keeps the ids of runs it has met lately, in bounded
memory; a text then costs one look-up a run, and the library sees only new ones. Texts with other
characters than Latin ones are looked up by whole words.
"""

from __future__ import annotations

import re
import sys
from array import array

from .lately import Lately

#: Bytes of the runs and ids that a worker keeps.
KEPT_BYTES = 128 << 20
#: Runs that the library gets as one text.
JOINED = 500
#: Texts of characters that the vocabulary's normaliser only lower-cases, one by one.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The pre-tokeniser's split, for plain characters in lower case.
_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\\s]+")
#: White space for str.split(), but not for the vocabulary.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


class WordTokens:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        import numpy as np

        vocabulary = self.library.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known = Lately(most=KEPT_BYTES)

    def _packed(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text by the library."""
        found = [array("I", e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for ids in found:
                ids.byteswap()
        return [ids.tobytes() for ids in found]

    def _made(self, wanted: list[str]) -> list[bytes]:
        """The ids of runs and words. Plain runs are one word of the vocabulary each,
        so many of them are a text, and fall apart where words end."""
        import numpy as np

        out: dict[str, bytes] = {}
        runs = [x for x in wanted if _RUNS.fullmatch(x) and _PLAIN.fullmatch(x)]
        parts = [runs[i : i + JOINED] for i in range(0, len(runs), JOINED)]
        for part, data in zip(parts, self._packed([" ".join(p) for p in parts])):
            ends = 4 * (np.flatnonzero(self.is_end[np.frombuffer(data, "<u4")]) + 1)
            if len(ends) == len(part) and ends[-1] == len(data):
                ends = ends.tolist()
                out |= zip(part, [data[a:b] for a, b in zip([0, *ends], ends)])
        rest = [x for x in wanted if x not in out]
        if rest:
            out |= zip(rest, self._packed(rest))
        return [out[x] for x in wanted]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split: list[list[str] | None] = []
        for t in texts:
            if any(s in t for s in self.special):
                split.append(None)
            elif _PLAIN.fullmatch(t):
                split.append(_RUNS.findall(t.lower()))
            else:
                split.append(None if any(s in t for s in _SEPARATORS) else t.split())
        get = self.known.look_up(set().union(*(s for s in split if s)), self._made).__getitem__
        return [self._packed([t])[0] if s is None else b"".join(map(get, s)) for t, s in zip(texts, split)]


_LOADED: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's own tokeniser for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]
