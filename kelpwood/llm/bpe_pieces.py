"""SentencePiece merge-type (BPE) encoding and decoding.

A word's characters are symbols; an agenda holds the adjacent pairs that make
a vocabulary piece, and gives the pair with the best score, the leftmost of
equals, until none is left. Symbols that are no pieces become bytes. No piece
of the vocabulary holds a space sign behind another character, so no merge
crosses the start of a word; nor does one cross two characters that stand next
to each other in no piece, so a word falls into parts there. Each Python worker
keeps the ids of words and of parts it met lately, in bounded memory.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lately import Lately
from .shared import map_arrow, whole_text

#: Bytes of what a worker keeps of words and of parts that it met lately.
WORDS_BYTES, PARTS_BYTES = 288 << 20, 160 << 20
#: Characters that are encoded at once in a worker.
CHUNK_CHARS = 1_000_000

#: Words of at most so many characters keep their agenda in a plain list.
SHORT = 48
NONE = float("inf")

SPACE = "▁"
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PieceCodec:
    """Encoder and decoder of one vocabulary file, which the library reads."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i) or self.library.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.rank = {p: -self.library.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if self.library.is_byte(i)}
        self.unknown = self.library.unk_id()
        self.surface = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        size = lambda v: 150 + len(v[1]) + len(v[2])
        self.words, self.parts = Lately(size, WORDS_BYTES), Lately(size, PARTS_BYTES)
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        crossing = [p for p in self.ids if re.search(f"[^{SPACE}]{SPACE}", p)]
        if crossing or len(self.bytes) != 256:
            raise ValueError("the vocabulary must be of the merge type with byte fallback, and keep words apart")

    def merge(self, word: str) -> list[int]:
        """Ids of one word by the agenda of adjacent pairs."""
        symbols = self._short(word) if len(word) <= SHORT else self._long(word)
        ids, out = self.ids, []
        for s in symbols:
            i = ids.get(s)
            if i is None:
                out += [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return out

    def _short(self, word: str) -> list[str]:
        """Few symbols: the agenda is a list by place, searched for its best pair."""
        rank = self.rank.get
        symbols = list(word)
        agenda = [rank(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while agenda:
            best = min(agenda)
            if best == NONE:
                break
            i = agenda.index(best)
            symbols[i : i + 2] = [pair] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + pair, NONE)
            if i < len(agenda):
                agenda[i] = rank(pair + symbols[i + 1], NONE)
        return symbols

    def _long(self, word: str) -> list[str]:
        """Many symbols: the agenda is a heap of (rank, place), and symbols are linked
        to their neighbours; an entry whose pair has changed is passed over."""
        rank = self.rank.get
        symbols, n = list(word), len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i) for i in range(n - 1) if (r := rank(word[i : i + 2], NONE)) != NONE]
        heapq.heapify(agenda)
        while agenda:
            r, i = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or rank(pair := symbols[i] + symbols[j], NONE) != r:
                continue
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(pair + symbols[k], NONE)) != NONE:
                    heapq.heappush(agenda, (r, i))
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] + pair, NONE)) != NONE:
                heapq.heappush(agenda, (r, h))
        return [s for s in symbols if s]

    def pieces(self, text: str) -> list[str]:
        """The words of a text, each with the space signs before it."""
        return _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def split(self, word: str) -> list[str]:
        """The parts of a word that no merge joins."""
        near = self.neighbours
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in near]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def made_parts(self, parts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """(number of ids, ids in decimal joined by commas, bytes) of each part."""
        surface, out = self.surface, []
        for ids in map(self.merge, parts):
            out.append((len(ids), ",".join(map(str, ids)).encode(), b"".join([surface[i] for i in ids])))
        return out

    def made_words(self, words: list[str]) -> list[tuple[int, bytes, bytes]]:
        """The same of each word."""
        split = list(map(self.split, words))
        known = self.parts.look_up({p for ps in split for p in ps}, self.made_parts)
        found = [[known[p] for p in ps] for ps in split]
        return [f[0] if len(f) == 1 else (sum([x[0] for x in f]), b",".join([x[1] for x in f]), b"".join([x[2] for x in f])) for f in found]

    def encode(self, text: str) -> list[int]:
        return [i for w in self.pieces(text) for p in self.split(w) for i in self.merge(p)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: space signs become spaces, the one put in front goes."""
        out = b"".join([self.surface[i] for i in ids])
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")

    def summaries(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """(number of ids, ids in decimal joined by commas, decoded bytes) of each text."""
        split = [self.pieces(t) for t in texts]
        known = self.words.look_up({w for s in split for w in s}, self.made_words)
        out = []
        for s in split:
            got = [known[w] for w in s]
            decoded = b"".join([g[2] for g in got])
            out.append((sum([g[0] for g in got]), b",".join([g[1] for g in got]), decoded[1:] if decoded[:1] == b" " else decoded))
        return out


_LOADED: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The worker's own codec for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = PieceCodec(path)
    return _LOADED[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, check_every: int = 0) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for whole texts, and with
    ``with_ids`` also ids (array<int>) and decoded.

    With ``check_every`` = n, the library encodes and decodes every n-th text of
    an Arrow batch too, and a difference fails the job.

    Defined results: null and empty texts have no ids and decode to the empty
    text; characters outside the vocabulary become bytes; repeated rows give
    equal rows; null ids pass through; an empty table gives an empty one; other
    columns are dropped.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        from .bpe_pieces import CHUNK_CHARS, codec

        own = codec(model_path)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
            found = own.summaries(texts)
            if check_every:
                picked = range(0, len(texts), check_every)
                for i, theirs in zip(picked, own.library.encode([texts[i] for i in picked], num_threads=1)):
                    if ",".join(map(str, theirs)).encode() != found[i][1] or own.library.decode(theirs).encode() != found[i][2]:
                        raise ValueError(f"the library encodes {texts[i][:80]!r} differently")
            cols = [pa.array(ids, pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([sha(f[1]) for f in found]), pa.array([sha(f[2]) for f in found])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array([[int(x) for x in f[1].split(b",")] if f[1] else [] for f in found], pa.list_(pa.int32())), pa.array([f[2].decode("utf-8", "replace") for f in found])]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            ids, texts, chars = [], [], 0
            for i, t in zip(batch.column(0), batch.column(1)):
                ids.append(i.as_py())
                texts.append(t.as_py())
                chars += len(texts[-1])
                if chars >= CHUNK_CHARS:
                    yield rows(ids, texts)
                    ids, texts, chars = [], [], 0
            if ids:
                yield rows(ids, texts)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")), run, schema)
