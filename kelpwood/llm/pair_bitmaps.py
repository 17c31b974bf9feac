"""Alignment of two tokenizers by inverted pair bitmaps.

A text's tokens of vocabulary A (byte-level merges) and B (merge pieces) are cut
into groups at the byte offsets where tokens of both end. A and B tokens of one
group are linked. Documents are dealt to blocks as they are read; in a block,
each linked pair of ids has a bitmap of the block's documents that hold it, and
binary planes of how often each links it. Bitmaps are compressed: sorted 16-bit
places where few documents hold a pair, plain bits where many do.

The bitmaps of a pair are disjoint over blocks, so the corpus-wide number of
documents is the sum of their popcounts. Each posting then brings its pair's
count back to the documents whose bits it holds, in the block where they are.
No pair has more postings than there are blocks times planes, whatever the text.

Texts are encoded by chunks: neither vocabulary joins a character to a single
space between two others, so a text falls apart there. Workers keep the
alignments of chunks they met lately, bounded by bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lately import Lately
from .shared import map_arrow, shared_folder, stored, whole_text

#: Characters of a block's texts, about, and its documents at most (places have 16 bits).
BLOCK_CHARS, BLOCK_DOCS = 16_000_000, 65_536
#: Characters that are encoded at once in a worker.
CHUNK_CHARS = 1_000_000
#: Rows of a record batch.
ROWS = 50_000
SPACE = "▁"

_CUT = re.compile(r"(?<=\S)(?= \S)")
#: White space other than the space, by Python's rule, which holds all that vocabulary A's split goes by.
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


def chunks(text: str) -> list[str]:
    """The chunks of space + text, each without the space that it starts with."""
    odd = "  " in text or text[:1].isspace() or text[-1:].isspace()
    if not odd:
        odd = any(c in text and (" " + c in text or c + " " in text) for c in _WHITE)
    return text.split(" ") if not odd else [c[1:] for c in _CUT.split(" " + text)]


def segments(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut before chunks; their spaces are left out."""
    at = 0
    while len(text) - at > 2 * size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start() + 1
    yield text[at:]


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 characters for themselves, the others in turn for those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Both tokenizers of a worker, and the alignments it made lately."""

    def __init__(self, a_path: str, b_path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        bytes_of = byte_level()
        self.a_bytes = {i: bytes([bytes_of[c] for c in t]) if all(c in bytes_of for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)}
        how = json.loads(self.a.to_str())
        split = how["pre_tokenizer"] or {}
        self.by_chunks = how["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.by_chunks = self.by_chunks and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.known = Lately(lambda v: 160 + len(v[3]) + len(v[4]) if v else 16)

    def split(self, text: str) -> Iterator[list[str]]:
        if not self.by_chunks:
            yield [text]
        else:
            yield from map(chunks, segments(text))

    def align(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]]:
        """The groups of A's and B's tokens of the same bytes."""
        a_bytes, b_bytes, groups = self.a_bytes, self.b_bytes, []
        i = j = 0
        while i < len(a):
            first, second, ahead = i, j, 0  # ahead: bytes that A is ahead of B
            while i == first or ahead:
                if ahead <= 0 and i < len(a) and (ahead < 0 or i == first):
                    ahead += len(a_bytes[a[i]])
                    i += 1
                else:
                    ahead -= len(b_bytes[b[j]])
                    j += 1
            groups.append((a[first:i], b[second:j]))
        return groups

    def made(self, words: list[str]) -> list:
        """(A's tokens, B's tokens, groups, the groups as text, linked pairs as 64-bit
        numbers) of each chunk; None where the tokens' bytes differ from the chunk's."""
        import numpy as np

        left = [e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        right = self.b.encode(words, num_threads=1)
        out = []
        for w, a, b in zip(words, left, right):
            plain = b" " + w.encode("utf-8", "surrogatepass")
            if b"".join([self.a_bytes[x] for x in a]) != plain or b"".join([self.b_bytes[x] for x in b]) != plain:
                out.append(None)
                continue
            groups = self.align(a, b)
            text = ";".join([",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups])
            if len(a) + len(b) < 64:
                pairs = np.array([x << 32 | y for xs, ys in groups for x in xs for y in ys], np.int64)
            else:
                pairs = np.concatenate([((np.array(xs, np.int64) << 32)[:, None] | np.array(ys, np.int64)).ravel() for xs, ys in groups])
            out.append((len(a), len(b), len(groups), text.encode(), pairs.tobytes()))
        return out


_LOADED: dict[tuple, Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Aligner(a_path, b_path)
    return _LOADED[a_path, b_path]


class TextLinks:
    """What is known of a text after some of its chunks."""

    def __init__(self):
        import hashlib

        self.sha, self.counts, self.links, self.parts, self.odd = hashlib.sha256(), [0, 0, 0], 0, [], False

    def add(self, found: list) -> None:
        import numpy as np

        if self.odd or None in found:
            self.odd, self.parts = True, []
            return
        a, b, groups, text, pairs = zip(*found)
        self.sha.update((b";" if self.counts[2] else b"") + b";".join(text))
        self.counts = [self.counts[0] + sum(a), self.counts[1] + sum(b), self.counts[2] + sum(groups)]
        key, times = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_counts=True)
        self.links += int(times.sum())
        self.parts.append((key, times))

    def pairs(self):
        """Distinct pairs of the text, and how often it links them."""
        import numpy as np

        if len(self.parts) < 2:
            return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        key, place = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return key, np.bincount(place, np.concatenate([t for _, t in self.parts]), len(key)).astype(np.int64)

    def row(self) -> tuple:
        return (0, 0, 0, 0, "") if self.odd or not self.counts[2] else (*self.counts, self.links, self.sha.hexdigest())


def _plane(pair, doc, plane: int, n_docs: int) -> Iterator[list]:
    """A plane's postings (pair, plane, n, dense, bitmap) as Arrow arrays, sparse ones first."""
    import numpy as np
    import pyarrow as pa

    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    counts = np.diff(np.append(first, len(pair)))
    dense = 16 * counts > n_docs
    in_dense = np.repeat(dense, counts)
    bits = np.zeros((int(dense.sum()), n_docs), np.uint8)
    bits[np.repeat(np.arange(len(bits)), counts[dense]), doc[in_dense]] = 1
    packed = np.packbits(bits, axis=1)
    for kind, data, widths in ((False, doc[~in_dense].astype("<u2"), 2 * counts[~dense]), (True, packed, np.full(len(bits), packed.shape[1]))):
        n, mine = len(widths), dense == kind
        if n:
            ends = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
            yield [pa.array(pair[first[mine]]), pa.array(np.full(n, plane, np.int32)), pa.array(counts[mine].astype(np.int32)), pa.array(np.full(n, kind)), binary]


def bitmaps(pair, doc, times, n_docs: int) -> Iterator[list]:
    """The postings of a block, whose arrays ascend by pair and doc: plane 0 has the
    documents that hold a pair, plane k + 1 those whose times less one have bit k."""
    if len(pair):
        yield from _plane(pair, doc, 0, n_docs)
    rest, plane = times - 1, 1
    while rest.any():
        more = rest > 0
        pair, doc, rest = pair[more], doc[more], rest[more]
        bit = (rest & 1) > 0
        if bit.any():
            yield from _plane(pair[bit], doc[bit], plane, n_docs)
        rest, plane = rest >> 1, plane + 1


DOC = "block long, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
POSTING = "pair long, plane int, n int, dense boolean, bitmap binary"


def index(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents (pair is null) and of postings (row is null), by block."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .pair_bitmaps import BLOCK_CHARS, BLOCK_DOCS, CHUNK_CHARS, ROWS, TextLinks, aligner, bitmaps

        own = aligner(a_path, b_path)
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        names = [c.split()[0] for c in f"{DOC}, {POSTING}".split(", ")]
        block = TaskContext.get().partitionId() << 32
        waiting: list = []  # (text, chunks)
        ids, rows, keys, times, chars, waiting_chars = [], [], [], [], 0, 0

        def feed() -> None:
            known = own.known.look_up({c for _, cs in waiting for c in cs}, own.made)
            for text, cs in waiting:
                text.add([known[c] for c in cs])
            waiting.clear()

        def batch(columns: list) -> pa.RecordBatch:
            n = len(next(c for c in columns if c is not None))
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *(pa.nulls(n, k) if c is None else c for c, k in zip(columns, kinds[1:]))], names=names)

        def flush() -> Iterator:
            feed()
            doc_pairs = [t.pairs() if not t.odd else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for t in rows]
            cols = list(zip(*[t.row() for t in rows]))
            for at in range(0, len(rows), ROWS):
                part = slice(at, at + ROWS)
                yield batch([pa.array(np.arange(len(rows), dtype=np.int32)[part]), pa.array(ids[part], pa.int64()), *(pa.array(c[part], k) for c, k in zip(cols, kinds[3:8])), *[None] * 5])
            pair = np.concatenate([p for p, _ in doc_pairs])
            doc = np.repeat(np.arange(len(rows)), [len(p) for p, _ in doc_pairs])
            many = np.concatenate([t for _, t in doc_pairs])
            order = np.argsort(pair, kind="stable")
            for arrays in bitmaps(pair[order], doc[order], many[order], len(rows)):
                for at in range(0, len(arrays[0]), ROWS):
                    yield batch([*[None] * 7, *(a.slice(at, ROWS) for a in arrays)])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                ids.append(i.as_py())
                text = t.as_py()
                rows.append(TextLinks())
                for cs in own.split(text) if text else ():
                    waiting.append((rows[-1], cs))
                    waiting_chars += sum(map(len, cs)) + len(cs)
                    if waiting_chars >= CHUNK_CHARS:
                        feed()
                        waiting_chars = 0
                chars += len(text)
                if chars >= BLOCK_CHARS or len(rows) >= BLOCK_DOCS:
                    yield from flush()
                    block, ids, rows, chars, waiting_chars = block + 1, [], [], 0, 0
        if rows:
            yield from flush()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return map_arrow(texts, run, f"{DOC}, {POSTING}")


def pair_table(postings: DataFrame) -> DataFrame:
    """(pair, a, b, docs, links, best): how many documents link the ids a and b, how
    often all of them do, and whether no pair of a has more documents."""
    popcount = F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("docs")
    times = F.sum(F.expr("n * shiftleft(1L, greatest(plane - 1, 0))")).alias("links")
    counts = postings.groupBy("pair").agg(popcount, times).withColumns({"a": F.shiftright("pair", 32).cast("int"), "b": F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")})
    highest = counts.groupBy("a").agg(F.max("docs").alias("highest"))
    return counts.join(highest, "a").select("pair", "a", "b", "docs", "links", (F.col("docs") == F.col("highest")).alias("best"))


def scores(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(block, row, count_sum, n_best): what the postings bring to the documents of their bits."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .pair_bitmaps import BLOCK_DOCS

        now, count_sum, n_best = None, None, None

        def done() -> pa.RecordBatch:
            row = np.flatnonzero(count_sum)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), now)), pa.array(row.astype(np.int32)), pa.array(count_sum[row]), pa.array(n_best[row])], names=["block", "row", "count_sum", "n_best"])

        for batch in batches:
            block, plane, dense, docs, best = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4, 5))
            maps = batch.column(3)
            times = np.int64(1) << np.maximum(plane.astype(np.int64) - 1, 0)
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
            for a, b in zip(edges, np.append(edges[1:], len(block)) if len(block) else []):
                if now is None or block[a] != now:
                    if now is not None:
                        yield done()
                    now, count_sum, n_best = block[a], np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
                value, hits = (docs * times)[a:b], (best * times)[a:b]
                part, plain = maps.slice(a, b - a), dense[a:b].astype(bool)
                sparse = part.filter(pa.array(~plain))
                widths = np.diff(np.frombuffer(sparse.buffers()[1], np.int32)[sparse.offset : sparse.offset + len(sparse) + 1]) // 2 if len(sparse) else np.zeros(0, np.int64)
                places = np.frombuffer(b"".join(sparse.to_pylist()), "<u2") if len(sparse) else np.zeros(0, np.uint16)
                np.add.at(count_sum, places, np.repeat(value[~plain], widths))
                np.add.at(n_best, places, np.repeat(hits[~plain], widths))
                for i in np.flatnonzero(plain):
                    places = np.flatnonzero(np.unpackbits(np.frombuffer(part[int(i)].as_py(), np.uint8)))
                    count_sum[places] += value[i]
                    n_best[places] += hits[i]
        if now is not None:
            yield done()

    brought = postings.join(pairs.select("pair", "docs", "best"), "pair").select("block", "plane", "dense", "bitmap", "docs", F.col("best").cast("long").alias("best"))
    return map_arrow(brought.repartition("block").sortWithinPartitions("block"), run, "block long, row int, count_sum long, n_best long")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_a, n_b (tokens), n_groups, n_links (pairs
    of an A and a B token of one group), n_best (links whose pair is in as many
    documents as any of its A id), count_sum (of the links' document counts) and
    groups_sha256.

    A encodes space + text without special tokens, B the text, to which it adds a
    space. Defined results: null and empty texts, and texts whose tokens' bytes
    differ from space + text, have no tokens: zeros and an empty digest; every row
    is a document, repeated or not; null ids pass through; an empty table gives an
    empty one; other columns are dropped.
    """
    rows = stored(index(docs, a_path, b_path, id_col, text_col), f"{shared_folder(docs.sparkSession)}/index")
    postings, texts = rows.filter(F.col("pair").isNotNull()), rows.filter(F.col("row").isNotNull())
    found = scores(postings.select("block", "pair", "plane", "n", "dense", "bitmap"), pair_table(postings))
    out = texts.select(*[c.split()[0] for c in DOC.split(", ")]).join(found, ["block", "row"], "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
