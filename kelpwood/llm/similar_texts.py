"""Near copies by a similarity threshold: the SimHash trie join with wide fingerprints.

A Jaccard similarity of 0.8 leaves SimHash about 15% differing bits, ten of 64:
too many for views that can miss no pair. So a text gets several words of 64
bits from its distinct shingles, each word is cut into blocks, and texts that
agree on any one block meet in a trie, where node pairs are traversed together
and dropped beyond the error budget of their word; all words together must be
within a budget as well.

What the tries link are candidates: their forests connect all texts that could
be similar, and no similar pair that a trie reaches lies in two candidate
components. Inside a component all pairs within the budget of all words are
compared by whole shingle sets, nearest first, but for those that compared
links have connected already: only such links make groups. So neither an
untrue tie nor a number of rounds can hide a true one. A component of more
texts than a task takes is dealt to parts by a hash, and tasks take its parts
in pairs.

Both budgets are four standard deviations above what a pair of exactly the
wanted similarity has on average. With five words of six blocks such a pair
misses all 30 blocks with a probability of 0.4%, one of similarity 0.9 with
0.0003%. Larger tables want more bits in a block (fewer blocks) and more words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import gathered, map_arrow, shared_folder, stored
from .simhash import component_ids, keep_first, trie_join, with_node

SHINGLE, SIMILARITY = 5, 0.8
WORDS, BLOCKS = 5, 6
#: Texts of a candidate component that a task takes from one part.
PART_SETS = 2048
#: Bytes of the bit rows by which the sets of a task are compared; larger ones are merged in order.
BIT_ROWS = 64 << 20
#: Pairs that a task compares at once.
CHUNK_COMPARED = 4096
#: Texts and links of a partition, at least.
PART_TEXTS, PART_LINKS = 10_000, 100_000
#: Texts whose sets or fingerprints a worker hands on at once.
CHUNK_TEXTS = 256


def shingle_set(text: str, shingle: int = SHINGLE):
    """Ascending hashes of the distinct shingles; a text without words has one, the empty one."""
    import numpy as np

    from .simhash import shingle_hashes

    return np.unique(np.array(shingle_hashes(text, shingle) or [0], np.uint64))


def wide_fingerprint(hashes, words: int = WORDS) -> list[int]:
    """SimHash of a set in several words: the hashes as they are, then mixed anew for each word."""
    import numpy as np

    from .simhash import majority

    out = []
    for k in range(words):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        if k:
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
        out.append(majority(x))
    return out


def bit_budget(bits: int, similarity: float) -> int:
    """Bits that a pair of this Jaccard similarity differs in: the mean and four standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(bits, math.ceil(bits * share + 4 * math.sqrt(bits * share * (1 - share))))


def wide_fingerprints(rows: DataFrame, shingle: int, words: int) -> DataFrame:
    """(doc_id, node, text) to (doc_id, node, words)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .similar_texts import CHUNK_TEXTS, shingle_set, wide_fingerprint

        for batch in (b.slice(at, CHUNK_TEXTS) for b in batches for at in range(0, b.num_rows, CHUNK_TEXTS)):
            flat = np.array([wide_fingerprint(shingle_set(t.as_py(), shingle), words) for t in batch.column(2)], np.uint64).reshape(-1)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))], names=["doc_id", "node", "words"])

    return map_arrow(rows, run, "doc_id long, node long, words array<long>")


def sets_of(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, text) to (node, hashes): whole sets."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .similar_texts import CHUNK_TEXTS, shingle_set

        for batch in (b.slice(at, CHUNK_TEXTS) for b in batches for at in range(0, b.num_rows, CHUNK_TEXTS)):
            found = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "hashes"])

    return map_arrow(rows, run, "node long, hashes array<long>")


def common_sizes(sets: list):
    """A function of places i and j (arrays) that gives the sizes of the sets' intersections."""
    import numpy as np

    sizes = np.array([len(x) for x in sets])
    flat, place = np.unique(np.concatenate(sets), return_inverse=True)
    if len(sets) * (len(flat) // 64 + 1) * 8 > BIT_ROWS:
        return lambda i, j: np.array([np.isin(sets[a], sets[b], assume_unique=True).sum() for a, b in zip(i.tolist(), j.tolist())])
    bits = np.zeros((len(sets), len(flat) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(sets)), sizes), place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))

    def of(i, j):
        step = max(1, BIT_ROWS // (16 * bits.shape[1]))
        return np.concatenate([np.bitwise_count(bits[i[at : at + step]] & bits[j[at : at + step]]).sum(axis=1, dtype=np.int64) for at in range(0, len(i), step)])

    return of


def similar_links(words, sets: list, side, budget: int, similarity: float):
    """(i, j) of links that connect all pairs of sets that have the similarity and
    whose words differ in no more than ``budget`` bits; a forest.

    words: a row of uint64 for each set. side: 0 and 1 for the members of two parts,
    of which only pairs across are compared, or all 0. Each set offers its nearest
    set that it isn't connected with, until no set has one left.
    """
    import numpy as np

    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    labels = np.arange(n)
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(n), np.arange(n))
    far = np.iinfo(np.uint16).max
    bits = np.zeros((len(a), len(b)), np.uint16)
    for w in range(words.shape[1]):
        bits += np.bitwise_count(words[a, w][:, None] ^ words[b, w][None, :])
    small, large = np.minimum(sizes[a][:, None], sizes[b][None, :]), np.maximum(sizes[a][:, None], sizes[b][None, :])
    bits[(bits > budget) | (small < similarity * large - 1e-9)] = far
    if not side.any():
        np.fill_diagonal(bits, far)
    common, out = None, []
    rows, cols = np.arange(len(a)), np.arange(len(b))
    while True:
        bits[labels[a][:, None] == labels[b][None, :]] = far
        near, back = bits.argmin(axis=1), bits.argmin(axis=0)
        i, j = np.concatenate([rows, back]), np.concatenate([near, cols])
        found = np.flatnonzero(bits[i, j] != far)
        if not len(found):
            return out
        i, j = np.unique(np.stack([i[found], j[found]]), axis=1)
        bits[i, j] = far
        if not side.any():
            bits[j, i] = far
        common = common or common_sizes(sets)
        i, j = a[i], b[j]
        for at in range(0, len(i), CHUNK_COMPARED):
            x, y = i[at : at + CHUNK_COMPARED], j[at : at + CHUNK_COMPARED]
            both = common(x, y)
            alike = both >= similarity * (sizes[x] + sizes[y] - both) - 1e-9
            for x, y in zip(x[alike].tolist(), y[alike].tolist()):
                p, q = labels[x], labels[y]
                if p != q:
                    labels[labels == max(p, q)] = min(p, q)
                    out.append((x, y))


def linked(members: DataFrame, budget: int, similarity: float) -> DataFrame:
    """Members (task, side, node, words, hashes) of candidate components to links (a, b)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .similar_texts import similar_links

        def links(held: list) -> pa.RecordBatch:
            side, node = np.array([r[0] for r in held]), [r[1] for r in held]
            found = similar_links(np.array([r[2] for r in held]), [r[3] for r in held], side, budget, similarity)
            return pa.RecordBatch.from_arrays([pa.array([node[p[k]] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        task, held = None, []
        for batch in batches:
            flat = [batch.column(k).to_pylist() for k in range(3)]
            words, sets = ([x.values.to_numpy().view(np.uint64) for x in batch.column(k)] for k in (3, 4))
            for t, s, n, w, h in zip(*flat, words, sets):
                if t != task:
                    if len(held) > 1:
                        yield links(held)
                    task, held = t, []
                held.append((s, n, w, h))
        if len(held) > 1:
            yield links(held)

    return map_arrow(members.repartition("task").sortWithinPartitions("task", "side", "node"), run, "a long, b long")


def _found(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, words: int, blocks: int, part_sets: int) -> DataFrame:
    """(doc_id, node, root, component_id) for every row of docs."""
    folder = shared_folder(docs.sparkSession)
    source = with_node(docs, id_col, text_col)
    rows = stored(wide_fingerprints(source, shingle, words), f"{folder}/fingerprints")
    n = rows.count()
    texts = stored(gathered(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("words").alias("words")), n, PART_TEXTS), f"{folder}/texts")
    whole = bit_budget(64 * words, similarity)
    ties = trie_join(texts.select("node", "words"), bit_budget(64, similarity), blocks, 1, whole).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    candidates = stored(gathered(components(stored(gathered(ties, n, PART_LINKS), f"{folder}/ties")), n, PART_LINKS), f"{folder}/candidates")
    # Components of more texts than a part takes: each text goes to the tasks of its part with every part.
    parts = candidates.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / part_sets).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int")
    members = candidates.join(parts, "root").withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select("node", F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("task"), F.when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side"))
    sets = sets_of(source.select("node", "text").join(candidates.select("node"), "node", "left_semi"), shingle).dropDuplicates(["node"])
    sets = stored(gathered(sets.join(texts.select("node", "words"), "node"), n, PART_TEXTS), f"{folder}/sets")
    links = linked(members.join(sets, "node").select("task", "side", "node", "words", "hashes"), whole, similarity)
    tied = components(stored(gathered(links, n, PART_LINKS), f"{folder}/links"))
    labelled = stored(component_ids(texts.select("node", "least"), tied, "node"), f"{folder}/labelled")
    return rows.select("doc_id", "node").join(labelled, "node")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, words: int = WORDS, blocks: int = BLOCKS, part_sets: int = PART_SETS) -> DataFrame:
    """(doc_id, component_id) for every row of docs.

    component_id: the smallest doc_id that can be reached over pairs of texts
    whose sets of ``shingle`` words have a Jaccard similarity of ``similarity``
    or more. No other pair is linked; how surely such a pair is found says the
    head of this module.

    Defined results: null and empty texts, and texts without words, are equal;
    a text with fewer words than ``shingle`` is one shingle; repeated rows give
    repeated rows; null ids are larger than any other id, so a component
    without ids has a null component_id; an empty table gives an empty one;
    other columns of docs don't matter.
    """
    return _found(docs, id_col, text_col, shingle, similarity, words, blocks, part_sets).select("doc_id", "component_id")


def drop_similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, words: int = WORDS, blocks: int = BLOCKS, part_sets: int = PART_SETS) -> DataFrame:
    """One document of each component stays, with the columns of docs: see simhash.keep_first."""
    return keep_first(docs, _found(docs, id_col, text_col, shingle, similarity, words, blocks, part_sets), id_col, text_col)
