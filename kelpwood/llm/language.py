"""Language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of the n-grams that enough of its training
texts hold. The filters have one length and the same hashes, and are kept
bit-sliced: row r of the table is a mask with a bit for each language whose
filter has bit r set. The rows of an n-gram, combined by AND, give all
languages that contain it at once. A text's decision counts, for each language,
the n-grams it contains, less what its filter's false positives would give.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import held_out, in_sample
from .shared import fresh, map_arrow, shared_folder, stored, whole_text

#: Bytes of an n-gram, hashes of a filter, and log2 of a filter's length.
GRAM, HASHES, BITS = 4, 2, 20
#: Training texts of each language, at most about so many.
SAMPLE_TEXTS = 4_000
#: An n-gram belongs to a language if at least this share of its training texts hold it, and two of them if there are two.
LEAST_SHARE = 0.005
UNKNOWN = "und"


def gram_hashes(data, offsets):
    """(row, hash) of the n-grams of a block: lower case, runs of anything that
    is no letter, digit or longer character as one space, a space at both ends."""
    import numpy as np

    from . import bytes_text as B

    low = B.LOWER[data]
    row, start, end = B.spans(low, offsets, B.WORD_BYTE)
    if not len(row):
        return row, np.zeros(0, np.uint64)
    # Each word is copied behind a space; the first of a row also has the space of the row before in front.
    lengths = end - start + 1
    at = np.cumsum(lengths) - lengths
    text = np.full(lengths.sum() + 1, 32, np.uint8)
    source = np.arange(len(text) - 1) - np.repeat(at, lengths) + np.repeat(start, lengths) - 1
    letter = np.ones(len(text) - 1, bool)
    letter[at] = False
    text[:-1][letter] = low[source[letter]]
    of = np.repeat(row, lengths)
    n = len(text) - GRAM + 1
    if n <= 0:
        return row[:0], np.zeros(0, np.uint64)
    first = np.arange(n)
    h = B.range_hashes(text, first, first + GRAM)
    last = np.minimum(first + GRAM - 1, len(of) - 1)
    # The last byte may be the space after a row's last word.
    inside = (of[first] == of[last]) | (text[first + GRAM - 1] == 32) & (of[first] == of[np.maximum(last - 1, 0)])
    return of[first][inside], h[inside]


def text_gram_hashes(data) -> Iterator:
    """The n-grams of one long text's bytes, segment by segment: (hashes, sign).
    Each segment reaches to the end of the next word, whose own n-grams then come
    once more with sign -1: they are those of the next segment's start."""
    import numpy as np

    from . import bytes_text as B

    for start, end, next_end in B.segments(data, B.WORD_BYTE):
        for at, sign in ((start, 1), (end, -1)):
            part = data[at:next_end]
            if len(part):
                yield gram_hashes(part, np.array([0, len(part)]))[1], sign


def positions(hashes, bits: int):
    """HASHES rows of the table for each hash, as one array after the other."""
    import numpy as np

    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(HASHES)]


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_TEXTS, bits: int = BITS, least_share: float = LEAST_SHARE) -> dict:
    """languages (sorted), masks (list of arrays of 2^bits uint64, 64 languages
    each) and false_positives (one rate a language).

    n-grams are counted by grouped sums over a sample of at most about
    ``sample`` texts a language, outside the held-out fold; what comes to the
    driver is bounded by the length of the table. Rare n-grams, below ``least_share``
    of a language's texts, are left out of its filter; a language with a single
    training text has all of this text's.
    """
    import numpy as np

    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), whole_text(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out("id"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return {"languages": [], "masks": [], "false_positives": []}
    picked = F.lit(False)
    for lang, n in sizes.items():
        picked = picked | ((F.col("lang") == lang) & in_sample("id", n, sample))

    def grams(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from . import bytes_text as B
        from .language import gram_hashes, text_gram_hashes

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, data, offsets in B.blocks(batch.column(1)):
                if len(data) > 2 * B.BLOCK_BYTES:  # a single long text
                    h = np.unique(np.concatenate([np.unique(h) for h, sign in text_gram_hashes(data) if sign > 0]))
                    row = np.zeros(len(h), np.int64)
                else:
                    row, h = gram_hashes(data, offsets)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                row, h = row[new], h[new]
                here = langs[first : first + len(offsets) - 1]
                for lang in sorted(set(here)):
                    values, counts = np.unique(h[here[row] == lang], return_counts=True)
                    texts = int((here == lang).sum())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(values) + 1)), pa.array(np.append(values.view(np.int64), 0)), pa.array(np.append(counts, 0)), pa.array(np.append(np.zeros(len(values), np.int64), texts))], names=["lang", "gram", "n", "texts"])

    counted = stored(map_arrow(rows.filter(picked).select("lang", "text"), grams, "lang string, gram long, n long, texts long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), f"{folder}/grams")
    texts = {r["lang"]: r["t"] for r in counted.groupBy("lang").agg(F.sum("texts").alias("t")).collect()}
    least, place = F.lit(2.0), F.lit(0)
    for k, lang in enumerate(languages):
        least = F.when(F.col("lang") == lang, max(min(2.0, texts.get(lang, 0)), least_share * texts.get(lang, 0))).otherwise(least)
        place = F.when(F.col("lang") == lang, k).otherwise(place)
    own = counted.filter(F.col("n") >= least).select(place.alias("place"), "gram")
    step = F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1))
    low = (1 << bits) - 1  # positions() on signed numbers: only the low bits matter, so no sum overflows
    spots = F.array(*[(F.col("gram").bitwiseAND(F.lit(low)) + F.lit(k) * step.bitwiseAND(F.lit(low))).bitwiseAND(F.lit(low)) for k in range(HASHES)])
    sliced = own.select((F.col("place") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, place % 64)").alias("mask"), F.explode(spots).alias("row"))
    table = sliced.groupBy("word", "row").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = [np.zeros(1 << bits, np.uint64) for _ in range((len(languages) + 63) // 64)]
    words, at, bit = (table.column(c).to_numpy() for c in ("word", "row", "mask"))
    for w, m in enumerate(masks):
        m[at[words == w]] = bit[words == w].astype(np.int64).view(np.uint64)
    filled = [float(np.count_nonzero(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / (1 << bits)) for k in range(len(languages))]
    return {"languages": languages, "masks": masks, "false_positives": [f**HASHES for f in filled]}


def identify(docs: DataFrame, model: dict, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """docs with lang_pred and score.

    Defined results: ``und`` with score 0 for texts that are null or have no
    letter; a text whose n-grams no language knows, or that ties, gets the
    first language in alphabetical order; without training texts all are
    ``und``; repeated rows get equal results; columns of docs named lang_pred
    or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    text = fresh("text_", docs.columns)
    rows = docs.withColumn(text, whole_text(text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from . import bytes_text as B
        from .language import UNKNOWN, gram_hashes, positions, text_gram_hashes

        model = shared.value
        languages, fp = model["languages"], np.array(model["false_positives"])
        names = np.array([*languages, UNKNOWN], object)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            pred, score = np.full(batch.num_rows, len(languages)), np.zeros(batch.num_rows)
            lettered = np.asarray(pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False), bool)
            for first, data, offsets in B.blocks(column):
                n = len(offsets) - 1
                total, hits = np.zeros((n, 1)), np.zeros((n, len(languages)))
                if len(data) > 2 * B.BLOCK_BYTES:  # a single long text
                    parts = ((np.zeros(len(h), np.int64), h, sign) for h, sign in text_gram_hashes(data))
                else:
                    parts = [(*gram_hashes(data, offsets), 1)]
                for row, h, sign in parts:
                    total[:, 0] += sign * np.bincount(row, minlength=n)
                    at = positions(h, bits)
                    for w, table in enumerate(model["masks"]):
                        found = table[at[0]]
                        for p in at[1:]:
                            found = found & table[p]
                        for k in range(64 * w, min(len(languages), 64 * w + 64)):
                            hits[:, k] += sign * np.bincount(row[(found >> np.uint64(k % 64) & np.uint64(1)).astype(bool)], minlength=n)
                if not languages:
                    continue
                true = np.maximum(0, (hits - total * fp) / np.maximum(1 - fp, 1e-9))
                best = true.argmax(1)
                share = true[np.arange(n), best] / np.maximum(total[:, 0], 1)
                use = lettered[first : first + n]
                pred[first : first + n][use] = best[use]
                score[first : first + n][use] = np.minimum(1, share[use])
            cols = [c for k, c in enumerate(batch.columns) if batch.schema.names[k] != text]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names[pred].tolist(), pa.string()), pa.array(score)], names=[*(x for x in batch.schema.names if x != text), "lang_pred", "score"])

    schema = T.StructType([f for f in rows.schema.fields if f.name != text] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_arrow(rows, run, schema)
