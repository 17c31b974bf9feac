"""Exact ranked lexical search: sparse ball trees over term impacts.

A document is a sparse vector of its terms' impacts, an item one of its terms'
weights, and a score is their inner product in whole numbers. Only terms of the
items can add to it, so documents are kept in these coordinates alone. They are
cut into blocks, and each block becomes a ball tree: a node has a centroid and a
radius, and no document below it scores more than

    <item, centroid> + |item| * radius,

rounded up. Nodes are opened best first; a subtree whose bound is under the last
of the best ``k`` so far is pruned, and leaves are scored exactly. The best of a
task's earlier blocks prune its later ones. A term's weight is divided evenly
over both vectors (its root in each), which keeps balls tight for the inner
product.

Items come to the tasks in batches of bounded size, each with one pass over the
documents; no document comes to the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, map_arrow, shared_folder, stored, whole_text

#: Results of an item.
BEST = 20
#: Bytes of items' texts in a batch, about (a single item may be longer).
BATCH_BYTES = 2_000_000
#: Documents of a block at most, and numbers of a block's centroids.
BLOCK_DOCS, BLOCK_CENTROIDS = 16_384, 4_000_000
#: Documents of a leaf at most.
LEAF_DOCS = 64
#: Bounds are raised by this share and by one, far more than what floats lose.
SLACK = 1e-9
#: Parts of an item's results that are ranked before they meet.
RANK_PARTS = 64

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in turn: runs of ASCII letters and digits and all other characters beyond ASCII, A-Z in lower case."""
    return _TERM.findall(text.encode("utf-8", "surrogatepass").lower())


def hashes_of(terms: list[bytes]):
    """The hash by which a term is looked up in whole texts."""
    import numpy as np

    from .bytes_text import range_hashes

    ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
    data = np.frombuffer(b"".join(terms), np.uint8)
    return range_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def document_terms(docs: DataFrame, hashes: list[int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) for each document that has any term: n counts all of
    them with repeats; terms are places in ``hashes`` (ascending), tfs their occurrences."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .bytes_text import BLOCK_BYTES, LOWER, WORD_BYTE, blocks, range_hashes, segments, spans

        known = np.array(hashes, np.uint64)

        def counted(data, offsets):
            """Terms of each row, and (row, term, times) of the known ones."""
            data = LOWER[data]
            row, start, end = spans(data, offsets, WORD_BYTE)
            h = range_hashes(data, start, end)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            key, times = np.unique(row[hit] * len(known) + at[hit], return_counts=True)
            return np.bincount(row, minlength=len(offsets) - 1), key // len(known), key % len(known), times

        def whole(data):
            """One long text, in segments that end between terms."""
            parts = [counted(data[a:b], np.array([0, b - a])) for a, b, _ in segments(data, WORD_BYTE)]
            total = np.zeros(len(known), np.int64)
            for _, _, term, times in parts:
                total[term] += times
            term = np.flatnonzero(total)
            return sum(p[0] for p in parts), np.zeros(len(term), np.int64), term, total[term]

        for batch in batches:
            for first, data, offsets in blocks(batch.column(1)):
                n, row, term, times = whole(data) if len(offsets) == 2 and len(data) > 2 * BLOCK_BYTES else counted(data, offsets)
                has = np.flatnonzero(n)
                ends = np.searchsorted(row, np.arange(len(n)), "right")[has].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(x.astype(np.int32))) for x in (term, times)]
                ids = batch.column(0).slice(first, len(n)).take(pa.array(has))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[has]), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, n long, terms array<int>, tfs array<int>")


class BallTree:
    """Rows of a sparse matrix (starts, cols, values; values not negative) in a tree of balls.

    order: the rows in the order of the leaves; nodes: (first, last, left, right),
    left and right -1 for a leaf; centroids and radii of the nodes. A radius is
    rounded up.
    """

    def __init__(self, starts, cols, values, width: int, leaf: int = LEAF_DOCS):
        import numpy as np

        n = len(starts) - 1
        self.order = np.arange(n)
        self.nodes: list[list[int]] = []
        centroids, radii = [], []
        squares = np.concatenate([[0.0], np.cumsum(values * values)])
        norms = squares[starts[1:]] - squares[starts[:-1]]
        stack = [(0, n, -1, 0)]
        while stack:
            first, last, parent, side = stack.pop()
            node = len(self.nodes)
            self.nodes.append([first, last, -1, -1])
            if parent >= 0:
                self.nodes[parent][2 + side] = node
            rows = self.order[first:last]
            counts = starts[rows + 1] - starts[rows]
            place = np.repeat(starts[rows] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            row, col, value = np.repeat(np.arange(len(rows)), counts), cols[place], values[place]

            def along(direction):
                return np.bincount(row, value * direction[col], len(rows))  # noqa: B023

            def point(i):
                dense = np.zeros(width)
                a, b = starts[rows[i]], starts[rows[i] + 1]  # noqa: B023
                dense[cols[a:b]] = values[a:b]
                return dense

            centroid = np.bincount(col, value, width) / len(rows)
            own = norms[rows]
            far = np.maximum(0.0, own - 2 * along(centroid) + centroid @ centroid)
            centroids.append(centroid)
            radii.append(math.sqrt(far.max() + SLACK * (own.max() + centroid @ centroid)) * (1 + SLACK))
            if len(rows) > leaf:
                a = point(int(far.argmax()))
                b = point(int((own - 2 * along(a)).argmax()))
                ranked = np.argsort(along(b - a), kind="stable")
                self.order[first:last] = rows[ranked]
                mid = (first + last) // 2
                stack += [(mid, last, node, 1), (first, mid, node, 0)]
        self.centroids, self.radii = np.array(centroids), np.array(radii)

    def bounds(self, cols, values):
        """For each node a number that no row below it exceeds in the inner product with a vector of values >= 0."""
        import numpy as np

        return (self.centroids[:, cols] @ values + math.sqrt(values @ values) * self.radii) * (1 + SLACK) + np.float64(1)


def search(tree: BallTree, starts, cols, impacts, ids, item, roots, best, k: int):
    """Merge the rows' best scores for an item into ``best`` (scores, ids), best first.

    starts, cols, impacts, ids: the matrix in the tree's order, in whole numbers;
    item: (cols, weights), whole numbers; roots: of the terms' own weights. Returns
    (best, leaves scored).
    """
    import heapq

    import numpy as np

    terms, weights = item
    dense = np.zeros(len(roots), np.int64)
    dense[terms] = weights
    shared = np.divide(weights, roots[terms], out=np.zeros(len(terms)), where=roots[terms] > 0)
    bounds, nodes = tree.bounds(terms, shared).tolist(), tree.nodes
    least = int(best[0][-1]) if len(best[0]) == k else 1
    agenda, scored = [(-bounds[0], 0)], 0
    while agenda:
        bound, node = heapq.heappop(agenda)
        if -bound < least:
            break
        first, last, left, right = nodes[node]
        if left >= 0:
            # A child's own bound may be the looser one.
            for child in (left, right):
                b = min(-bound, bounds[child])
                if b >= least:
                    heapq.heappush(agenda, (-b, child))
            continue
        scored += 1
        a, b = starts[first], starts[last]
        sums = np.concatenate([[0], np.cumsum(dense[cols[a:b]] * impacts[a:b])])
        scores = sums[starts[first + 1 : last + 1] - a] - sums[starts[first:last] - a]
        good = np.flatnonzero(scores >= least)
        if len(good):
            all_scores, all_ids = np.concatenate([best[0], scores[good]]), np.concatenate([best[1], ids[first:last][good]])
            top = np.lexsort((all_ids, -all_scores))[:k]
            best = all_scores[top], all_ids[top]
            if len(top) == k:
                least = int(best[0][-1])
    return best, scored


def tree_search(rows: DataFrame, items: list, weights: list[int], n_docs: int, n_terms: int, k: int, block: int = BLOCK_DOCS) -> DataFrame:
    """(item, doc_id, score) of each task's best for each item: items are (term places, times)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .ball_tree import BLOCK_CENTROIDS, LEAF_DOCS, BallTree, search

        w = np.array(weights, np.int64)
        roots = np.sqrt(w)
        wanted = [(np.array(t, np.int64), np.array(c, np.int64) * w[t]) for t, c in items]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        none = np.iinfo(np.int64).max  # stands for a missing id
        most = max(LEAF_DOCS, min(block, BLOCK_CENTROIDS * LEAF_DOCS // (4 * len(w))))

        def grow(held: list) -> None:
            part = pa.Table.from_batches(held).combine_chunks()
            ids = part["doc_id"].fill_null(none).to_numpy()
            n = part["n"].to_numpy()
            lengths = 100 - 25 + 25 * n * n_docs // n_terms
            lists = part["terms"].combine_chunks()
            starts = lists.offsets.to_numpy().astype(np.int64)
            cols = lists.flatten().to_numpy().astype(np.int64)
            tf = part["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
            starts -= starts[0]
            counts = np.diff(starts)
            impacts = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(lengths, counts))
            tree = BallTree(starts, cols, impacts * roots[cols], len(w))
            place = np.repeat(starts[tree.order] - np.cumsum(counts[tree.order]) + counts[tree.order], counts[tree.order]) + np.arange(len(cols))
            starts = np.concatenate([[0], np.cumsum(counts[tree.order])])
            for i, item in enumerate(wanted):
                best[i], _ = search(tree, starts, cols[place], impacts[place], ids[tree.order], item, roots, best[i], k)

        held, rows_held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                if rows_held + piece.num_rows > most:
                    grow(held)
                    held, rows_held = [], 0
                held.append(piece)
                rows_held += piece.num_rows
        if held:
            grow(held)
        for i, (scores, ids) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array(ids, mask=ids == none), pa.array(scores)], names=["item", "doc_id", "score"])

    return map_arrow(rows, run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each item with their rank: in parts first, then together."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(RANK_PARTS))
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("item", part).orderBy(*order))).filter(F.col("place") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def _batches(items: DataFrame, bound: int) -> Iterator[list]:
    """Lists of (item id, texts): each of about ``bound`` bytes."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // bound))
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b)
        yield [(r["item_id"], r["texts"]) for r in part.groupBy("item_id").agg(F.sort_array(F.collect_set("text")).alias("texts")).collect()]


def ranked_search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", batch_bytes: int = BATCH_BYTES, block: int = BLOCK_DOCS) -> DataFrame:
    """(item id, rank, doc_id, score): for each item its ``k`` best documents of score above 0.

    Terms, weights and scores are those of the module's contract in the README:
    whole numbers, so ranks are exact; equal scores rank by ascending doc_id. Two
    terms are told apart by a 64-bit hash.

    Defined results: null and empty texts have no terms, and don't count as
    documents; an item without terms has no results; repeated documents are found
    as often as they occur; a null doc_id is larger than any other; an item id
    with several texts is one item with the terms of all distinct ones; items
    with a null id are one item; an empty table on either side gives an empty
    one; other columns are dropped.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    kind = items.schema[item_col].dataType.simpleString()
    texts = items.select(F.col(item_col).alias("item_id"), whole_text(item_text).alias("text"))
    out = None
    for b, batch in enumerate(_batches(texts, batch_bytes)):
        counts = [(i, [terms_of(t) for t in ts]) for i, ts in batch]
        terms = sorted({t for _, ts in counts for x in ts for t in x})
        if not terms:
            continue
        by_hash = sorted(zip(hashes_of(terms).tolist(), terms))
        place = {t: at for at, (_, t) in enumerate(by_hash)}
        vectors, names = [], []
        for i, ts in counts:
            times: dict[int, int] = {}
            for t in (t for x in ts for t in x):
                times[place[t]] = times.get(place[t], 0) + 1
            if times:
                vectors.append((sorted(times), [times[t] for t in sorted(times)]))
                names.append((len(names), i))
        rows = stored(document_terms(docs, [h for h, _ in by_hash], id_col, text_col), f"{folder}/terms={b}")
        n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = dict(rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(by_hash))]
        found = stored(_ranked(tree_search(rows, vectors, weights, n_docs, n_terms, k, block), k), f"{folder}/found={b}")
        named = found.join(F.broadcast(spark.createDataFrame(names, f"item int, item_id {kind}")), "item").select("item_id", "rank", "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out.withColumnRenamed("item_id", item_col if item_col not in ("rank", "doc_id", "score") else fresh("item_id", out.columns))


#: The same in SQL.
SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
sizes AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
whole AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, nd),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // nt)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
