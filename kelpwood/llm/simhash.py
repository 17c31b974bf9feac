"""SimHash near-duplicates by a binary trie self-join.

Fingerprints of whole texts are made in Arrow batches. Distinct fingerprints
are then joined with themselves: all within the error budget of each other are
linked, and links are followed to components.

The join is cut into tries that tasks can hold. Fingerprints are cut into
``blocks`` blocks of bits; two that differ in at most ``budget`` bits agree on
at least blocks - budget of them, so each choice of that many blocks (a view)
and each value of these bits give a trie in which such pairs meet. In a trie,
node pairs are traversed together from the root: a pair of nodes carries the
number of bits in which their prefixes differ, and is dropped as soon as that
exceeds the budget, or when all leaves below are in one component already.
A hot trie is split: its subtries become tasks in pairs, again only where their
prefixes are within the budget.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import fresh, map_arrow, shared_folder, stored, whole_text

#: Leaves that a worker joins at once (whole tries, so a trie may be larger).
CHUNK_LEAVES = 100_000
#: Node pairs with no more leaf pairs than this are compared leaf by leaf.
LEAF_PAIRS = 64
#: Node pairs that a worker expands at once.
CHUNK_PAIRS = 60_000
#: Leaf pairs that a worker compares at once, beyond those of one node pair.
CHUNK_COMPARED = 1 << 20
#: Blocks of bits: with a budget of 4, 15 views of 20 bits or more.
BLOCKS = 6
#: Shingle hashes whose bits are counted at once.
CHUNK_HASHES = 1 << 16


def shingle_hashes(text: str, shingle: int) -> list[int]:
    """XXH64 (seed 42) of the shingles of a text, with repeats: A-Z lower-cased,
    words between white space. Fewer words are one shingle; no words give none."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return [digest(joined, 42)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-shingle]])
    return [digest(joined[s:e], 42) for s, e in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())]


def majority(hashes) -> int:
    """The bits that over half of the hashes (uint64) have."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    values = hashes.astype(">u8")
    for at in range(0, len(values), CHUNK_HASHES):
        part = values[at : at + CHUNK_HASHES]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(values)).tobytes(), "big")


def text_fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit SimHash of a text; no words give zero."""
    import numpy as np

    return majority(np.array(shingle_hashes(text, shingle), np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, node, fp) for each row: a hash of its text, and its fingerprint as a signed bigint."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .simhash import text_fingerprint

        for batch in batches:
            texts = batch.column(2)
            fps = np.fromiter((text_fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "node", "fp"])

    return map_arrow(with_node(docs, id_col, text_col), run, "doc_id long, node long, fp long")


def with_node(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, text): node is a 64-bit hash of the text."""
    text = whole_text(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))


def _merge(labels, a, b, bits) -> list:
    """Give the components of a[i] and b[i] one label, the smaller index. Returns
    (a, b, bits) of the pairs that did so, the ones of fewest bits: a forest."""
    import numpy as np

    used = []
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return used
        a, b, la, lb, bits = a[apart], b[apart], la[apart], lb[apart], bits[apart]
        high = np.maximum(la, lb)
        order = np.lexsort((bits, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        used.append((a[first], b[first], bits[first]))
        labels[high[first]] = np.minimum(la, lb)[first]
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def trie_links(fp, roots, budget: int, words=None, word_budget: int = 0):
    """Links of leaves through the tries: (labels, a, b, bits).

    fp: uint64 fingerprints; roots: rows (a_lo, a_hi, b_lo, b_hi) of node pairs
    to traverse, ranges of fp in which it ascends; a range with itself for a
    self-join. Leaves within ``budget`` bits are linked; with ``words`` (a row
    of uint64 for each leaf) only if these differ in ``word_budget`` bits at
    most, all words together.

    a, b and bits are a forest that connects all linked leaves, those of few bits
    first, and labels the smallest index in each leaf's component.
    """
    import numpy as np

    n = len(fp)
    labels = np.arange(n)
    found: list = []

    def compare(i, j):
        bits = np.bitwise_count(fp[i] ^ fp[j])
        near = np.flatnonzero((bits <= budget) & (labels[i] != labels[j]))
        i, j, bits = i[near], j[near], bits[near].astype(np.int64)
        if words is not None and len(i):
            bits = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
            near = bits <= word_budget
            i, j, bits = i[near], j[near], bits[near]
        if len(i):
            found.extend(_merge(labels, i, j, bits))

    # Neighbours in order are often links; known components prune whole node pairs.
    lo, hi = np.zeros(n, bool), np.zeros(n, bool)
    lo[roots[:, 0]] = hi[roots[:, 1] - 1] = True
    lo[roots[:, 2]] = hi[roots[:, 3] - 1] = True
    inner = np.flatnonzero(~hi[:-1] & ~lo[1:])
    compare(inner, inner + 1)
    ones: dict[int, np.ndarray] = {}

    def one_bits(depth: int):
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((fp >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        return ones[depth]

    # Where more errors are allowed than short prefixes can have, nodes are compared leaf by leaf sooner.
    leaf_pairs = LEAF_PAIRS << min(6, max(0, budget - 4))
    stack = [(0, np.asarray(roots, np.int64).reshape(-1, 4), np.zeros(len(roots), np.int64))]
    changes, merged = None, -1
    while stack:
        depth, pairs, errors = stack.pop()
        if len(pairs) > CHUNK_PAIRS:
            half = len(pairs) // 2
            stack += [(depth, pairs[half:], errors[half:]), (depth, pairs[:half], errors[:half])]
            continue
        if merged != len(found):
            changes, merged = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])]), len(found)
        a_lo, a_hi, b_lo, b_hi = pairs.T
        same = (changes[a_lo] == changes[a_hi - 1]) & (changes[b_lo] == changes[b_hi - 1]) & (labels[a_lo] == labels[b_lo])
        pairs, errors = pairs[~same], errors[~same]
        a_lo, a_hi, b_lo, b_hi = pairs.T
        work = (a_hi - a_lo) * (b_hi - b_lo)
        small = (work <= leaf_pairs) | (depth == 64)
        if small.any():
            lo, width, other, counts = a_lo[small], (b_hi - b_lo)[small], b_lo[small], work[small]
            upto = np.cumsum(counts)
            cuts = np.searchsorted(upto, np.arange(CHUNK_COMPARED, upto[-1] + CHUNK_COMPARED, CHUNK_COMPARED)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(counts)]):
                if first >= last:
                    continue
                c, w = counts[first:last], width[first:last]
                w = np.repeat(w, c)
                step = np.arange(len(w)) - np.repeat(np.cumsum(c) - c, c)
                row = step // w
                i, j = np.repeat(lo[first:last], c) + row, np.repeat(other[first:last], c) + (step - row * w)
                up = i < j  # a range with itself has each pair twice
                compare(i[up], j[up])
        pairs, errors = pairs[~small], errors[~small]
        if not len(pairs):
            continue
        a_lo, a_hi, b_lo, b_hi = pairs.T
        ones_at = one_bits(depth)
        a_mid, b_mid = a_hi - (ones_at[a_hi] - ones_at[a_lo]), b_hi - (ones_at[b_hi] - ones_at[b_lo])
        selfs = (a_lo == b_lo) & (a_hi == b_hi)
        # The pairs that differ least are traversed first.
        nodes = np.concatenate([
            np.stack([a_lo, a_mid, b_lo, b_mid], 1), np.stack([a_mid, a_hi, b_mid, b_hi], 1),
            np.stack([a_lo, a_mid, b_mid, b_hi], 1), np.stack([a_mid, a_hi, b_lo, b_mid], 1)[~selfs],
        ])
        errs = np.concatenate([errors, errors, errors + 1, errors[~selfs] + 1])
        keep = np.flatnonzero((nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3]) & (errs <= budget))
        if len(keep):
            keep = keep[np.argsort(errs[keep], kind="stable")]
            stack.append((depth + 1, nodes[keep], errs[keep]))
    a, b, bits = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    return labels, a, b, bits


def trie_components(fp, roots, budget: int = 4):
    """For each leaf the smallest index in its component."""
    import numpy as np

    return trie_links(fp, np.asarray(roots, np.int64).reshape(-1, 4), budget)[0]


def _views(blocks: int, agree: int) -> list[int]:
    """The masks of all choices of ``agree`` out of ``blocks`` blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(blocks)]
    return [sum(c) for c in itertools.combinations(parts, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def trie_join(leaves: DataFrame, budget: int, blocks: int, agree: int, word_budget: int | None = None, hot_leaves: int = 100_000) -> DataFrame:
    """Leaves (node: long, words: array<long>) to links (a, b, bits) of nodes.

    Each word has a trie for each choice (view) of ``agree`` out of ``blocks``
    blocks of bits and each value of these bits. Leaves of a trie are linked if
    the word differs in ``budget`` bits at most, and all words together in
    ``word_budget``. Links are a forest of each trie, not all pairs.
    """
    masks = _views(blocks, agree)
    n_words = leaves.select(F.max(F.size("words"))).first()[0] or 0
    if not n_words:
        return leaves.sparkSession.createDataFrame([], "a long, b long, bits long")
    view = F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(k).alias("view"), F.col("words")[w].bitwiseAND(F.lit(_signed(m))).alias("bits")) for w in range(n_words) for k, m in enumerate(masks)]))
    leaves = leaves.select("node", "words", view.alias("v")).select("node", "words", "v.word", "v.view", "v.bits")
    whole = F.lit(0)
    # Hot tries: subtries by a prefix of the bits that the view leaves open, as pairs within the budget.
    hot = leaves.groupBy("word", "view", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_leaves)
    hot = stored(hot, f"{shared_folder(leaves.sparkSession)}/hot")
    if hot.isEmpty():
        tasks = leaves.withColumns({"i": whole, "j": whole, "side": whole})
    else:
        most = hot.agg(F.max("n")).first()[0]
        bits = max(1, min(12, (most // hot_leaves).bit_length()))
        free = [[b for b in range(63, -1, -1) if not m >> b & 1][:bits] for m in masks]
        own = F.element_at("words", F.col("word") + 1)
        prefix = F.lit(0)
        for k, at in enumerate(free):
            value = F.lit(0)
            for b in at:
                value = value * 2 + F.shiftrightunsigned(own, b).bitwiseAND(F.lit(1)).cast("int")
            prefix = F.when(F.col("view") == k, value).otherwise(prefix)
        near = [x for x in range(1 << bits) if x.bit_count() <= budget]
        marked = leaves.join(hot.select("word", "view", "bits", F.lit(True).alias("is_hot")), ["word", "view", "bits"], "left")
        marked = marked.withColumn("p", prefix).withColumn("x", F.explode(F.when(F.col("is_hot"), F.array(*map(F.lit, near))).otherwise(F.array(F.lit(-1)))))
        cold, other = F.col("x") < 0, F.col("p").bitwiseXOR(F.col("x"))
        tasks = marked.withColumns({
            "i": F.when(cold, -1).otherwise(F.least("p", other)), "j": F.when(cold, -1).otherwise(F.greatest("p", other)),
            "side": F.when(cold | (F.col("x") == 0), 0).when(F.col("p") < other, 1).otherwise(2),
        })
    # Tries that share a number are traversed as one, which changes no link.
    tasks = tasks.select(F.xxhash64("word", "view", "bits", "i", "j").alias("trie"), "side", "word", "node", "words")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .simhash import CHUNK_LEAVES, trie_links

        def join(cols: list) -> pa.RecordBatch:
            trie, side, word, node, words = cols
            fp = words[np.arange(len(word)), word]
            order = np.lexsort((fp, side, trie))
            trie, side, node, words, fp = trie[order], side[order], node[order], words[order], fp[order]
            lo = np.flatnonzero(np.concatenate([[True], trie[1:] != trie[:-1]]))
            hi = np.append(lo[1:], len(fp))
            mid = lo + np.add.reduceat((side < 2).astype(np.int64), lo)
            alone = side[lo] == 0
            roots = np.concatenate([np.stack([lo, hi, lo, hi], 1)[alone], np.stack([lo, mid, mid, hi], 1)[~alone & (lo < mid) & (mid < hi)]])
            wide = (words, word_budget) if word_budget is not None else (None, 0)
            _, a, b, bits = trie_links(fp, roots, budget, *wide)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(bits.astype(np.int64))], names=["a", "b", "bits"])

        def columns(batch) -> list:
            """trie, side, word, node and words."""
            words = batch.column(4)
            return [*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)), words.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(words), -1)]

        held: list = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(columns(batch))
            rows += batch.num_rows
            if rows < CHUNK_LEAVES:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            new = np.flatnonzero(cols[0][1:] != cols[0][:-1])
            if len(new):
                cut = new[-1] + 1
                yield join([c[:cut] for c in cols])
                held, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
            else:
                held = [cols]
        if rows:
            yield join([np.concatenate(c) for c in zip(*held)])

    return map_arrow(tasks.repartition("trie").sortWithinPartitions("trie"), run, "a long, b long, bits long")


def similar_edges(fps: DataFrame, budget: int = 4, blocks: int = BLOCKS, hot_leaves: int = 100_000) -> DataFrame:
    """Distinct fingerprints (fp long) to links (a, b) that connect all pairs
    within ``budget`` bits; a forest of each trie, not all pairs.

    Any number of blocks above the budget gives the same components: more of
    them make more and smaller tries.
    """
    if blocks <= budget:
        raise ValueError("there must be more blocks than differing bits")
    return trie_join(fps.select(F.col("fp").alias("node"), F.array("fp").alias("words")), budget, blocks, blocks - budget, hot_leaves=hot_leaves).select("a", "b")


def component_ids(members: DataFrame, tied: DataFrame, key: str) -> DataFrame:
    """(key, root, component_id) for all members (key, least): the smallest ``least``
    of each component in ``tied`` (node, root); a member that is not tied is its own."""
    known = tied.withColumnRenamed("node", key).join(members, key)
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = known.join(ids, "root").select(key, F.col("root").alias("tied_root"), "component_id")
    all_of = members.join(linked, key, "left")
    return all_of.select(key, F.coalesce("tied_root", key).alias("root"), F.when(F.col("tied_root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def _found(docs: DataFrame, id_col: str, text_col: str, shingle: int, budget: int, blocks: int, hot_leaves: int) -> DataFrame:
    folder = shared_folder(docs.sparkSession)
    rows = stored(fingerprints(docs, id_col, text_col, shingle), f"{folder}/fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/distinct")
    edges = stored(similar_edges(fps.select("fp"), budget, blocks, hot_leaves), f"{folder}/edges")
    labelled = stored(component_ids(fps, components(edges), "fp"), f"{folder}/labelled")
    return rows.join(labelled, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4, blocks: int = BLOCKS, hot_leaves: int = 100_000) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint: 16 lowercase hex digits; component_id: the smallest doc_id that
    can be reached over links of at most ``budget`` differing bits.

    Defined results: null and empty texts, and texts without words, have
    fingerprint zero and are linked like any others; a text with fewer words
    than ``shingle`` is one shingle; repeated rows give repeated rows; null ids
    are larger than any other id, so a component without ids has a null
    component_id; an empty table gives an empty one; other columns of docs
    don't matter.
    """
    found = _found(docs, id_col, text_col, shingle, budget, blocks, hot_leaves)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4, blocks: int = BLOCKS, hot_leaves: int = 100_000) -> DataFrame:
    """One document of each component stays, with the columns of docs: see keep_first."""
    return keep_first(docs, _found(docs, id_col, text_col, shingle, budget, blocks, hot_leaves), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component (rows doc_id, node, root) the document with the smallest id
    stays; of several texts with this id, or without any id, the one with the least
    hash. Rows with equal id and text are one document, and stay or go together."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("first")
    keep, keep_node, mine, node = (fresh(x, docs.columns) for x in ("keep_", "keepnode_", "mine_", "node_"))
    kept = found.groupBy("root").agg(first).select(F.col("first.doc_id").alias(keep), F.col("first.node").alias(keep_node))
    marked = docs.withColumns({mine: F.col(id_col).cast("long"), node: F.xxhash64(whole_text(text_col))})
    return marked.join(kept, F.col(mine).eqNullSafe(F.col(keep)) & (F.col(node) == F.col(keep_node)), "left_semi").select(*docs.columns)
