"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A text's features are the presence of its words, of long words' beginnings (which
inflected words share), word pairs and pairs with one word between them, hashed
to 2^bits coordinates. Each shard of a bounded sample of labelled texts is learned
in a task of its own by FTRL-proximal, with a rate for each coordinate; L1 keeps
most weights at zero. Shards are averaged by a grouped sum over coordinates, and
the few weights left are broadcast. Coordinates of fewer than ``least_texts`` of a
shard's texts don't enter its model; those of many do, whatever their share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_texts
from .shared import fresh, map_arrow, shared_folder, stored, whole_text

BITS = 20
BIAS = 0
#: Labelled texts that a model is fitted on, at most about so many.
SAMPLE_TEXTS = 48_000
#: Texts and bytes of text of a shard, about: enough to meet rare words, few enough for one task.
SHARD_TEXTS, SHARD_BYTES = 8_000, 24 << 20
#: A coordinate enters a shard's model if at least so many of its texts have it.
LEAST_TEXTS = 4
#: Words longer than so many bytes also count by their first so many.
BEGINNINGS = (5, 6, 7, 8)


def features(data, offsets, bits: int = BITS):
    """(row, coordinate) of each word, beginning, pair and skip-gram of a block, with repeats."""
    import numpy as np

    from . import bytes_text as B

    low = B.LOWER[data]
    row, start, end = B.spans(low, offsets, B.WORD_BYTE)
    h = B.range_hashes(low, start, end)
    rows, hashes = [row], [h]
    for k in BEGINNINGS:
        longer = end - start > k
        rows.append(row[longer])
        hashes.append(B.mixed(B.range_hashes(low, start[longer], start[longer] + k) + np.uint64(k)))
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            near = row[:-gap] == row[gap:]
            rows.append(row[:-gap][near])
            hashes.append(B.mixed(h[:-gap][near] * np.uint64(salt) + h[gap:][near]))
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    coordinate = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return rows, np.where(coordinate == BIAS, 1, coordinate)


def one_text_features(data, bits: int = BITS):
    """The distinct coordinates of one text's bytes, by segments that share two words."""
    import numpy as np

    from . import bytes_text as B

    found, back = [np.zeros(0, np.int64)], 0
    for _, end, _ in B.segments(data, B.WORD_BYTE):
        part = data[back:end]
        found.append(np.unique(features(part, np.array([0, len(part)]), bits)[1]))
        words = B.spans(part, np.array([0, len(part)]), B.WORD_BYTE)[1]
        back += int(words[-2]) if len(words) > 1 else 0
    return np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]


def text_features(text: str, bits: int = BITS):
    """The distinct coordinates of one text, the bias among them."""
    import numpy as np

    return np.union1d(one_text_features(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), bits), [BIAS])


class Ftrl:
    """FTRL-proximal for binary features."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0):
        import numpy as np

        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at):
        import numpy as np

        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at, label: int) -> None:
        import numpy as np

        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, sample: int = SAMPLE_TEXTS, epochs: int = 4, least_texts: int = LEAST_TEXTS) -> tuple[list[int], list[float]]:
    """(coordinates, weights) that are not zero. Without labelled texts there are none.

    The sample of ``sample`` texts bounds the rows that are learned from, the
    ``bits`` the weights that come to the driver.
    """
    folder = shared_folder(docs.sparkSession)
    rows = stored(labelled_texts(docs, labels, label, sample, id_col, text_col), f"{folder}/sample")
    total, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if not total:
        return [], []
    shards = max(1, round(total / SHARD_TEXTS), math.ceil(size / SHARD_BYTES))
    shard = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int")
    dealt = rows.repartitionById(shards, shard).sortWithinPartitions(F.xxhash64("id", "text"), "text")

    def learn(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .toxicity import BIAS, Ftrl, text_features

        found: list = []
        labels: list[int] = []
        with_it = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label")):
                found.append(text_features(text.as_py(), bits).astype(np.int32))
                with_it[found[-1]] += 1
                labels.append(label.as_py())
        if not found:
            return
        enter = with_it >= least_texts
        enter[BIAS] = True
        for i, at in enumerate(found):
            found[i] = at[enter[at]]
        model = Ftrl(bits)
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(len(found)).tolist():
                model.learn(found[i], labels[i])
        at = np.flatnonzero(model.n)
        w = model.weights(at)
        at, w = at[w != 0], w[w != 0]
        if not len(at):
            at, w = np.array([BIAS]), np.array([0.0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(w), pa.array(np.full(len(at), len(found), np.int64))], names=["at", "w", "n"])

    parts = stored(map_arrow(dealt.select("text", "label"), learn, "at long, w double, n long"), f"{folder}/weights")
    mean = parts.groupBy("at").agg((F.sum(F.col("w") * F.col("n")) / total).alias("w")).filter("w <> 0").collect()
    mean.sort()
    return [r["at"] for r in mean], [r["w"] for r in mean]


def score(docs: DataFrame, weights: tuple[list[int], list[float]], text_col: str = "text", out: str = "score", bits: int = BITS) -> DataFrame:
    """docs with a column ``out``: the probability of the label, for whole texts."""
    import numpy as np

    keep = docs.columns
    text = fresh("text_", keep)
    rows = docs.drop(out) if out in keep else docs
    rows = rows.withColumn(text, whole_text(text_col))
    compact = docs.sparkSession.sparkContext.broadcast((np.array(weights[0], np.int64), np.array(weights[1], np.float64)))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from . import bytes_text as B
        from .toxicity import BIAS, features, one_text_features

        at, w = compact.value
        table = np.zeros(1 << bits, np.float32)
        table[at] = w
        has = table != 0
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            logit = np.full(batch.num_rows, float(table[BIAS]))
            for first, data, offsets in B.blocks(column):
                if len(data) > 2 * B.BLOCK_BYTES:  # a single long text
                    logit[first] += float(table[one_text_features(data, bits)].sum())
                    continue
                row, c = features(data, offsets, bits)
                hit = has[c]
                both = np.unique((row[hit] << bits) | c[hit])
                logit[first : first + len(offsets) - 1] += np.bincount(both >> bits, weights=table[both & ((1 << bits) - 1)], minlength=len(offsets) - 1)
            p = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
            cols = [c for k, c in enumerate(batch.columns) if batch.schema.names[k] != text]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p)], names=[*(x for x in batch.schema.names if x != text), out])

    from pyspark.sql import types as T

    schema = T.StructType([f for f in rows.schema.fields if f.name != text] + [T.StructField(out, T.DoubleType())])
    return map_arrow(rows, run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **fitting) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 where score >= threshold).

    Learns from ``labels`` (id, label) only outside the held-out fold; nothing
    but the text enters a score. Columns of docs named score or predicted are
    replaced.

    Defined results: null and empty texts have the score of a text without
    words; without any labels all scores are 0.5; a document labelled twice
    counts as toxic if one label says so; repeated rows get equal scores; an
    empty table gives an empty one.
    """
    scored = score(docs.drop("score", "predicted"), fit(docs, labels, label, id_col, text_col, **fitting), text_col)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **fitting) -> DataFrame:
    """The rows that are not predicted to be toxic, with the columns of docs. Where
    nothing was learned, as there are no labels, none is."""
    p = fresh("p_", docs.columns)
    weights = fit(docs, labels, label, id_col, text_col, **fitting)
    if not weights[0]:
        return docs
    scored = score(docs, weights, text_col, p)
    return scored.filter(F.col(p) < threshold).select(*docs.columns)
