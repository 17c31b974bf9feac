"""Scores of texts under a smoothed n-gram model that is kept as a backoff automaton.

All n-grams of all training texts are counted, none is left out. A context is a
state; an n-gram is an arc from its context, with the logarithm of its
interpolated, discounted probability; a failure arc leads from a context to the
one without its first word, with the logarithm of the discounted mass. A text
takes one traversal from left to right, which carries the state and adds up.

    p(w | h) = (c(hw) - d) / c(h) + g(h) p(w | h'),  g(h) = sum of the d of h's followers / c(h)
    p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

d is one of three discounts of an order, for n-grams seen once, twice and more
often, estimated from how many there are of each count.

The model is as large as the corpus, so no task holds it. Texts are dealt to
blocks as they are read, and a block's n-grams are numbered. Each block asks for
the counts of its own n-grams: packed runs of keys, one for each range of hashes.
Tasks that own ranges add up what the blocks counted and answer in the order of
the keys, so an answer is a few bits for an n-gram. An n-gram's key is the number
of its context, which the round before gave, and that of its word. Contexts with
very many n-grams are spread over all ranges; how many followers they have, and
the counts of counts, are all that comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, shared_folder, ship, stored, whole_text

ORDER = 2
#: What is added to each unigram count.
ADDED = 0.1
#: Bytes of a block's texts, about. Much larger tables want larger blocks: see the README.
BLOCK_BYTES = 16 << 20
#: Tokens whose n-grams are in a range, about.
RANGE_TOKENS = 2_000_000
#: Contexts that may be spread over all ranges, at most.
HOT_CONTEXTS = 100_000
#: Tokens that a traversal takes in one go.
WINDOW = 100_000
FOLDS, HELD_OUT = 10, 0
#: Stands for the end of a text among the hashes of words.
END = 0x9D8F2B7A61C35E47

BLOCKS = "block long, doc_ids array<long>, held_out array<boolean>, lengths array<int>, hashes binary, tokens binary"
ASKED = "hot boolean, range int, block long, contexts binary, words binary, counts binary"
ANSWERS = "block long, hot boolean, range int, counts binary, ids binary, followers binary, context long, distinct long, ones long, twos long, threes long, fours long"


def held_out(id_col: str) -> Column:
    """Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def pack(values, ascending: bool = False) -> bytes:
    """Whole numbers as compressed planes of bytes, of their differences where they ascend."""
    import numpy as np
    import pyarrow as pa

    x = np.ascontiguousarray(values, dtype=np.int64)
    if ascending and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpack(data: bytes, ascending: bool = False):
    import numpy as np
    import pyarrow as pa

    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 8 * n, asbytes=True), np.uint8)
    x = np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).reshape(n)
    return np.cumsum(x) if ascending else x


def token_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of tokenised texts: the words' hashes in ascending order, and each token's place among them."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .backoff_automaton import BLOCK_BYTES, END, pack
        from .bytes_text import BLOCK_BYTES as PART
        from .bytes_text import LOWER, SPACE_BYTE, blocks, range_hashes, segments, spans

        word_byte = ~SPACE_BYTE
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        block = TaskContext.get().partitionId() << 32
        ids, held, lengths, found, size = [], [], [], [], 0

        def words(data, offsets):
            data = LOWER[data]
            row, start, end = spans(data, offsets, word_byte)
            return row, range_hashes(data, start, end)

        def done() -> pa.RecordBatch:
            hashes, tokens = np.unique(np.concatenate(found), return_inverse=True)
            row = [block, np.concatenate(ids), np.concatenate(held), np.concatenate(lengths).astype(np.int32), pack(hashes.view(np.int64), True), pack(tokens)]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

        for batch in batches:
            for first, data, offsets in blocks(batch.column(2)):
                n = len(offsets) - 1
                if n == 1 and len(data) > 2 * PART:
                    h = np.concatenate([words(data[a:b], np.array([0, b - a]))[1] for a, b, _ in segments(data, word_byte)])
                    row = np.zeros(len(h), np.int64)
                else:
                    row, h = words(data, offsets)
                counts = np.bincount(row, minlength=n)
                # Each text's words, then its end.
                tokens = np.full(len(h) + n, END, np.uint64)
                tokens[np.arange(len(h)) + row] = h
                found.append(tokens)
                lengths.append(counts + 1)
                ids.append(np.array(batch.column(0).slice(first, n).to_pylist(), object))
                held.append(batch.column(1).slice(first, n).to_numpy(zero_copy_only=False))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield done()
                    block, ids, held, lengths, found, size = block + 1, [], [], [], [], 0
        if found:
            yield done()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), whole_text(text_col).alias("text"))
    return map_arrow(rows, run, BLOCKS)


class Block:
    """A block's n-grams, numbered by order, and what is known of them.

    at[k]: for each token the number of the n-gram of order k that ends there, -1
    where the text has too few words before it; context[k], word[k], first[k]: of
    each n-gram the numbers of its context and word, and a token where it ends.
    counts[k], ids[k], followers[k]: from the answers; followers (for n-grams as
    contexts) are how many follow once, twice and more often.
    """

    def __init__(self, row: dict):
        import numpy as np

        self.row, self.np = row, np
        self.hashes, tokens = unpack(row["hashes"], True), unpack(row["tokens"])
        self.lengths = np.array(row["lengths"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.training = ~np.repeat(np.array(row["held_out"], bool), self.lengths)
        self.at = {1: tokens}
        self.context, self.word, self.first = {}, {1: np.arange(len(self.hashes))}, {}
        self.counts, self.ids, self.followers = {}, {}, {}

    def number(self, k: int) -> None:
        """Number the n-grams of order k > 1, of which those of order k - 1 are numbered."""
        np = self.np
        before, tokens = self.at[k - 1], self.at[1]
        whole = np.flatnonzero(before[:-1] >= 0) + 1
        ends = np.zeros(len(tokens) + 1, bool)
        ends[self.starts] = True
        whole = whole[~ends[whole]]
        keys, first, place = np.unique(before[whole - 1] * len(self.hashes) + tokens[whole], return_index=True, return_inverse=True)
        self.at[k] = np.full(len(tokens), -1)
        self.at[k][whole] = place
        self.context[k], self.word[k], self.first[k] = keys // len(self.hashes), keys % len(self.hashes), whole[first]

    def own_counts(self, k: int):
        at = self.at[k][self.training]
        return self.np.bincount(at[at >= 0], minlength=len(self.word[k]))

    def layout(self, k: int, ranges: int, hot_limit: float):
        """Which n-grams of order k the block asks for, in the order of asking, with
        their keys (context, word) and the runs (hot, range, from, to) of it."""
        np = self.np
        from .bytes_text import mixed

        if k == 1:
            asked, context, word, hot = self.word[1], np.zeros(len(self.hashes), np.int64), self.hashes, np.zeros(len(self.hashes), bool)
            spread = mixed(word.view(np.uint64))
        else:
            asked = np.flatnonzero(self.counts[k - 1][self.context[k]] > 0)
            context, word = self.ids[k - 1][self.context[k][asked]], self.ids[1][self.word[k][asked]]
            hot = self.counts[k - 1][self.context[k][asked]] > hot_limit
            spread = mixed(context.view(np.uint64))
            spread[hot] = mixed(spread[hot] ^ mixed(word[hot].view(np.uint64)))
        run = (spread % np.uint64(ranges)).astype(np.int64) + hot * ranges
        order = np.lexsort((word, context, run))
        run = run[order]
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
        runs = [(bool(r >= ranges), int(r % ranges), int(a), int(b)) for r, a, b in zip(run[first], first, np.append(first[1:], len(run)))]
        return asked[order], context[order], word[order], runs

    def take(self, k: int, answers: dict, ranges: int, hot_limit: float, hot: dict, last: bool) -> None:
        """Fill in the answers for order k: {(hot, range): row}; hot: {context id: followers}."""
        np = self.np
        asked, context, _, runs = self.layout(k, ranges, hot_limit)
        n = len(self.word[k])
        self.counts[k], self.ids[k] = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if k > 1:
            self.followers[k - 1] = np.zeros((len(self.word[k - 1]), 3), np.int64)
        for is_hot, r, a, b in runs:
            answer = answers[is_hot, r]
            self.counts[k][asked[a:b]] = unpack(answer["counts"])
            if not last:
                self.ids[k][asked[a:b]] = (r << 32) + (is_hot << 62) + unpack(answer["ids"])
            if k > 1:
                new = a + np.flatnonzero(np.concatenate([[True], context[a + 1 : b] != context[a : b - 1]]))
                mine = np.array([hot[c] for c in context[new].tolist()]) if is_hot else unpack(answer["followers"]).reshape(-1, 3)
                self.followers[k - 1][self.context[k][asked[new]]] = mine


def asked_of(block: Block, k: int, ranges: int, hot_limit: float) -> Iterator[tuple]:
    """The rows by which a block asks for order k."""
    own = block.own_counts(k)
    asked, context, word, runs = block.layout(k, ranges, hot_limit)
    for hot, r, a, b in runs:
        yield hot, r, block.row["block"], pack(context[a:b], True) if k > 1 else b"", pack(word[a:b], k == 1), pack(own[asked[a:b]])


def answered(rows: list[dict], k: int, last: bool) -> Iterator[tuple]:
    """Answers to all that was asked of a range, and the range's own figures (block is null)."""
    import numpy as np

    words = [unpack(r["words"], k == 1) for r in rows]
    contexts = [unpack(r["contexts"], True) for r in rows] if k > 1 else [np.zeros(len(w), np.int64) for w in words]
    word, context = np.concatenate(words), np.concatenate(contexts)
    order = np.lexsort((word, context))
    word, context = word[order], context[order]
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])]))
    total = np.add.reduceat(np.concatenate([unpack(r["counts"]) for r in rows])[order], first)
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    of = context[first]
    edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    followers = np.stack([np.add.reduceat(x.astype(np.int64), edge) for x in (total == 1, total == 2, total > 2)], 1)
    hot, r = rows[0]["hot"], rows[0]["range"]
    at = 0
    for row, mine in zip(rows, contexts):
        own = number[at : at + len(mine)]
        at += len(mine)
        new = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        known = pack(followers[np.searchsorted(of[edge], mine[new])].ravel()) if k > 1 and not hot else None
        yield row["block"], hot, r, pack(total[own]), None if last else pack(own), known, *[None] * 6
    if hot:
        for c, x in zip(of[edge].tolist(), followers.tolist()):
            yield None, hot, r, None, None, None, c, None, *x, None
    yield None, hot, r, None, None, None, None, int((total > 0).sum()), *[int((total == n).sum()) for n in (1, 2, 3, 4)]


def arrow_rows(rows: Iterator[tuple], schema: str, most: int = 16) -> Iterator:
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    fields = [c.split() for c in schema.split(", ")]
    held: list = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[f[1]]) for c, f in zip(zip(*held), fields)], names=[f[0] for f in fields])

    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield batch()
            held = []
    if held:
        yield batch()


def answers_to(asked: DataFrame, k: int, last: bool) -> DataFrame:
    """Owners of ranges answer: one range is in a task's memory at a time."""

    def run(batches: Iterator) -> Iterator:
        from .backoff_automaton import ANSWERS, answered, arrow_rows

        def rows() -> Iterator[tuple]:
            held: list = []
            for batch in batches:
                for row in batch.to_pylist():
                    if held and (row["hot"], row["range"]) != (held[0]["hot"], held[0]["range"]):
                        yield from answered(held, k, last)
                        held = []
                    held.append(row)
            if held:
                yield from answered(held, k, last)

        yield from arrow_rows(rows(), ANSWERS)

    return map_arrow(asked.repartition("hot", "range").sortWithinPartitions("hot", "range"), run, ANSWERS)


def discounts(ones: int, twos: int, threes: int, fours: int) -> list[float]:
    """Those of n-grams seen once, twice and more often, from the counts of counts; between 5% and 95% of the count."""
    share = ones / (ones + 2 * twos) if ones else 0.0
    out = []
    for n, now, then in ((1, ones, twos), (2, twos, threes), (3, threes, fours)):
        d = n - (n + 1) * share * then / now if now else 0.75 * n
        out.append(min(0.95 * n, max(0.05 * n, d)))
    return out


class Automaton:
    """The states and arcs that a block's texts can meet, numbered as its n-grams are.

    arc[k]: log10 of the probability of each n-gram of order k, 1 where it isn't in
    the model (there is no arc); failure[k]: log10 of the mass that the state of
    each n-gram of order k hands to the one below; unigrams always have an arc.
    """

    def __init__(self, block: Block, order: int, n_tokens: int, n_words: int, cuts: dict):
        np = block.np
        p = (block.counts[1] + ADDED) / (n_tokens + ADDED * (n_words + 1))
        self.known = block.counts[1] > 0
        self.arc, self.failure, self.order = {1: np.log10(p)}, {}, order
        for k in range(2, order + 1):
            c, below = block.counts[k], block.counts[k - 1]
            mass = np.divide(block.followers[k - 1] @ np.array(cuts[k]), below, out=np.ones(len(below)), where=below > 0)
            h = block.context[k]
            cut = np.array([0.0, *cuts[k]])[np.minimum(c, 3)]
            p = np.divide(c - cut, below[h], out=np.zeros(len(c)), where=c > 0) + mass[h] * p[block.at[k - 1][block.first[k]]]
            self.arc[k] = np.where(c > 0, np.log10(p, out=np.zeros(len(c)), where=c > 0), 1.0)
            self.failure[k - 1] = np.log10(mass, out=np.zeros(len(mass)), where=mass > 0)

    def traverse(self, block: Block, first: int, last: int) -> float:
        """The log10 probability of the tokens first to last, from the state without words."""
        total, depth, order = 0.0, 0, self.order
        for a in range(first, last, WINDOW):
            b = min(last, a + WINDOW)
            at = {k: block.at[k][a:b] for k in range(1, order + 1)}
            arcs = [None, *(block.np.where(at[k] >= 0, self.arc[k][at[k]], 1.0).tolist() if len(self.arc[k]) else [1.0] * (b - a) for k in range(1, order + 1))]
            # The failure arc of the state that the token before led to.
            back = max(first, a - 1)
            states = {k: block.at[k][back : b - 1] for k in range(1, order)}
            fails = [None, *(self.failure[k][x].tolist() if len(self.failure[k]) else [] for k, x in states.items())]
            known, lag = self.known[at[1]].tolist(), a - back - 1
            for i in range(b - a):
                k = depth + 1
                x = arcs[k][i]
                while x > 0:
                    k -= 1
                    total += fails[k][i + lag]
                    x = arcs[k][i]
                total += x
                depth = k if known[i] else 0
                if depth == order:
                    depth -= 1
        return total


def lm_scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (unigrams alone) and score (log10 probability of the text).

    Tokens are the words between white space, A-Z in lower case, then one end. The
    model learns from the documents that aren't held out. Words are told apart by a
    64-bit hash.

    Defined results: null and empty texts are an end alone; without training
    texts every unigram has the probability 1 and both scores are 0; repeated
    rows count as often as they occur; null ids are not held out, and pass
    through; an empty table gives an empty one; other columns are dropped.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    ship(spark)
    blocks = stored(token_blocks(docs, id_col, text_col), f"{folder}/blocks")
    n_all, n_tokens = blocks.select(F.explode(F.arrays_zip("lengths", "held_out")).alias("x")).agg(F.coalesce(F.sum("x.lengths"), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("x.held_out"), F.col("x.lengths"))), F.lit(0))).first()
    ranges = max(1, math.ceil(n_all / RANGE_TOKENS))
    hot_limit = max(1.0, n_tokens / min(ranges, HOT_CONTEXTS))
    n_words, cuts, hot, answers = 0, {}, {}, None

    def ready(left, right, upto: int, hot: dict) -> Block:
        """A block with the answers of the orders below ``upto``."""
        block = Block(left.to_pylist()[0])
        by_order: dict = {}
        for row in right.to_pylist():
            by_order.setdefault(row["n"], {})[row["hot"], row["range"]] = row
        for k in range(1, upto):
            if k > 1:
                block.number(k)
            block.take(k, by_order.get(k, {}), ranges, hot_limit, hot.get(k, {}), k == order)
        return block

    def asking(k: int, known: dict):
        def ask(left, right):
            import pyarrow as pa

            from .backoff_automaton import ASKED, arrow_rows, asked_of

            block = ready(left, right, k, known)
            if k > 1:
                block.number(k)
            batches = list(arrow_rows(asked_of(block, k, ranges, hot_limit), ASKED))
            return pa.Table.from_batches(batches) if batches else _empty(ASKED)

        return ask

    for k in range(1, order + 1):
        asked = _by_block(blocks, answers, asking(k, {**hot}), ASKED)
        found = stored(answers_to(asked, k, k == order), f"{folder}/answers={k}")
        figures = found.filter("block is null")
        totals = figures.filter("context is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("distinct", "ones", "twos", "threes", "fours"))).first()
        n_words = totals[0] if k == 1 else n_words
        cuts[k] = discounts(*totals[1:])
        # No more contexts than HOT_CONTEXTS are above the limit.
        spread = figures.filter("context is not null").groupBy("context").agg(F.sum("ones"), F.sum("twos"), F.sum("threes")).collect()
        hot[k] = {r[0]: list(r[1:]) for r in spread}
        found = found.filter("block is not null").select("block", F.lit(k).alias("n"), "hot", "range", "counts", "ids", "followers")
        answers = found if answers is None else answers.unionByName(found)

    def score(left, right):
        import numpy as np
        import pyarrow as pa

        from .backoff_automaton import Automaton

        block = ready(left, right, order + 1, hot)
        machine = Automaton(block, order, n_tokens, n_words, cuts)
        known = np.add.reduceat(machine.known[block.at[1]].astype(np.int64), block.starts[:-1])
        base = np.add.reduceat(machine.arc[1][block.at[1]], block.starts[:-1])
        scores = [machine.traverse(block, a, b) for a, b in zip(block.starts[:-1].tolist(), block.starts[1:].tolist())]
        n = len(scores)
        cols = [pa.array(block.row["doc_ids"], pa.int64()), pa.array(block.row["held_out"], pa.bool_()), pa.array(block.lengths), pa.array(known), pa.array(np.full(n, n_tokens, np.int64)), pa.array(base), pa.array(scores, pa.float64())]
        return pa.Table.from_arrays(cols, names=[c.split()[0] for c in SCORES.split(", ")])

    return _by_block(blocks, answers, score, SCORES)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _empty(schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.table({c.split()[0]: pa.array([], kinds[c.split()[1]]) for c in schema.split(", ")})


def _by_block(blocks: DataFrame, answers: DataFrame | None, function, schema: str) -> DataFrame:
    """function(block, answers to it) for each block; without answers, where the block is."""
    if answers is not None:
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(function, schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                yield from function(pa.Table.from_batches([batch.slice(i, 1)]), _empty("n int")).to_batches()

    return map_arrow(blocks, run, schema)
