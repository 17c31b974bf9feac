"""Quality by hierarchical empirical Bayes.

Each document gives evidence: the log likelihood ratio of a logistic
classifier over the shape of its text. Sites give priors: the share of good
documents of a host is drawn to the global share, and that of a path to its
host's, the more so the fewer documents there are. How strongly is estimated
from the spread between sites, by grouped sums. A document's posterior is its
evidence on top of its path's prior. The document itself is left out of the
path's, the host's and the global sums of its own prior, so a site of a single
document has its host's share, and a host of a single document the global one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import labelled_texts
from .shared import fresh, map_arrow, shared_folder, stored, whole_text

#: Labelled texts that the classifier is fitted on, at most about so many.
SAMPLE_TEXTS = 20_000
FEATURES = ("bias", "log_words", "upper", "symbols", "marks", "digits", "repeats", "few_words", "word_length")


def _members(chars: str):
    import numpy as np

    m = np.zeros(256, bool)
    m[list(chars.encode())] = True
    return m


#: Kinds of characters that are counted: small and capital letters, symbols, marks, digits.
KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*+<=>@[\\]^_`{|}~", "!?.,;:-'\"()/", "0123456789")


def shape_features(data, offsets):
    """One row of FEATURES for each row of a block."""
    import numpy as np

    from . import bytes_text as B

    n, kinds = len(offsets) - 1, [_members(k) for k in KINDS]
    if n == 1 and len(data) > 2 * B.BLOCK_BYTES:  # a single long text
        counts, again, words, seen = np.zeros(len(KINDS)), 0, 0, np.zeros(0, np.uint64)
        for start, end, next_end in B.segments(data, ~B.SPACE_BYTE):
            part = data[start:next_end]
            counts += [np.count_nonzero(k[data[start:end]]) for k in kinds]
            _, s, e = B.spans(part, np.array([0, len(part)]), ~B.SPACE_BYTE)
            h = B.range_hashes(B.LOWER[part], s, e)
            again += int(np.count_nonzero(h[1:] == h[:-1]))
            words += len(h) - (next_end > end)
            seen = np.union1d(seen, h)
        return _shape(counts[None], np.array([float(words)]), np.array([again]), np.array([len(seen)]), np.array([len(data)]))
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.stack([np.bincount(row_of[k[data]], minlength=n) for k in kinds], axis=1).astype(float)
    row, start, end = B.spans(data, offsets, ~B.SPACE_BYTE)
    words = np.bincount(row, minlength=n).astype(float)
    h = B.range_hashes(B.LOWER[data], start, end)
    again = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=n)
    order = np.lexsort((h, row))
    r, s = row[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
    return _shape(counts, words, again, np.bincount(r[new], minlength=n), np.diff(offsets))


def _shape(counts, words, again, distinct, sizes):
    """FEATURES from counts: of KINDS, words, words repeated at once, distinct words, bytes."""
    import numpy as np

    small, large, symbols, marks, digits = counts.T
    per_word = 1 / np.maximum(words, 1)
    return np.stack([
        np.ones(len(words)),
        np.log1p(words),
        large / np.maximum(small + large, 1),
        np.minimum(2, symbols * per_word),
        np.minimum(2, marks * per_word),
        np.minimum(2, digits * per_word),
        again * per_word,
        np.maximum(0, 0.6 - distinct * per_word) * (words > 0),
        np.minimum(20, sizes * per_word) / 10,
    ], axis=1)


def _with_features(df: DataFrame, text: str, make, out: str, kind: T.DataType) -> DataFrame:
    """df without ``text``, with make(feature rows) as a column ``out``."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from . import bytes_text as B
        from .quality import shape_features

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            found = [shape_features(data, offsets) for _, data, offsets in B.blocks(column)]
            rows = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
            cols = [c for k, c in enumerate(batch.columns) if batch.schema.names[k] != text]
            yield pa.RecordBatch.from_arrays([*cols, make(rows)], names=[*(x for x in batch.schema.names if x != text), out])

    return map_arrow(df, run, T.StructType([f for f in df.schema.fields if f.name != text] + [T.StructField(out, kind)]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_TEXTS, ridge: float = 0.02) -> tuple[list[float], float]:
    """(weights, odds): weights of FEATURES for the log likelihood ratio of label 1,
    and the log odds of label 1 in the sample. Fitted on at most about ``sample`` labelled rows, of
    which only the features come to the driver. Without both labels: no evidence.
    """
    import numpy as np
    import pyarrow as pa

    rows = labelled_texts(docs, labels, label, sample, id_col, text_col)
    as_list = lambda x: pa.array(list(x), pa.list_(pa.float64()))
    got = _with_features(rows, "text", as_list, "features", T.ArrayType(T.DoubleType())).select("label", "features").collect()
    y = np.array([r["label"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return [0.0] * len(FEATURES), 0.0
    x = np.array([r["features"] for r in got])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    odds = float(np.log(y.mean() / (1 - y.mean())))
    w[0] -= odds
    return w.tolist(), odds


def _strength(groups: DataFrame, good: str, rows: str, share: Column) -> float:
    """Beta prior strength by the method of moments: how far the groups' shares
    spread beyond what ``rows`` draws from their parent's share would give."""
    noise = share * (1 - share)
    got = groups.agg(
        F.sum((F.col(good) - F.col(rows) * share) ** 2 / F.col(rows)).alias("spread"),
        F.sum(noise).alias("noise"),
        F.sum(noise * (F.col(rows) - 1)).alias("gain"),
    ).first()
    # E[spread] = noise + gain * rho, where rho = 1 / (1 + strength)
    if not got["gain"] or got["spread"] is None:
        return 1.0
    rho = min(0.5, max(1e-4, (got["spread"] - got["noise"]) / got["gain"]))
    return (1 - rho) / rho


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Rows (host, path, p) to (host, path, n, good, host_n, host_good, host_share),
    and the global figures n, good, share, host_strength and path_strength.
    host_share is shrunk to the global share."""
    paths = stored(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good")), f"{shared_folder(rows.sparkSession)}/paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    n, good = total["n"] or 0, total["good"] or 0.0
    share = (good + 1) / (n + 2)
    host_strength = _strength(hosts, "host_good", "host_n", F.lit(share))
    hosts = hosts.withColumn("host_share", (F.col("host_good") + host_strength * share) / (F.col("host_n") + host_strength))
    sites = paths.join(hosts, "host")
    path_strength = _strength(sites, "good", "n", F.col("host_share"))
    return sites, {"n": n, "good": good, "share": share, "host_strength": host_strength, "path_strength": path_strength}


def prior_without(site: Column, p: Column, found: dict[str, float]) -> Column:
    """The share of good documents at a path, drawn to its host's and that to the
    global one, all without a document that is good with probability p."""
    share = (found["good"] - p + 1) / F.lit(found["n"] + 1)
    m = found["host_strength"]
    host = (site["host_good"] - p + m * share) / (site["host_n"] - 1 + m)
    m = found["path_strength"]
    path = (site["good"] - p + m * host) / (site["n"] - 1 + m)
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


NEW = ["host", "path", "evidence", "site_prior", "quality_score"]


def quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE_TEXTS, columns: list[str] | None = None) -> DataFrame:
    """docs with host, path, evidence (log likelihood ratio), site_prior,
    quality_score (posterior of being good, 0 to 1) and accepted.

    host and path are expressions over docs, by default ``source`` and ``lang``.
    ``columns`` are the columns of docs that are wanted, by default all; columns
    of docs with the names of the new ones are replaced.

    Defined results: null hosts and paths count as empty strings; null and
    empty texts get the evidence of a text without words; without labels of
    both kinds the evidence is 0; repeated rows get equal scores; an empty
    table gives an empty one; labels of the held-out fold are never read.
    """
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in (*NEW, "accepted")]
    scored, name = _scored(docs, labels, host, path, label, id_col, text_col, sample, kept)
    return scored.select(*kept, *[F.col(name[c]).alias(c) for c in NEW], (F.col(name["quality_score"]) >= threshold).alias("accepted"))


def _scored(docs: DataFrame, labels: DataFrame, host: Column | None, path: Column | None, label: str, id_col: str, text_col: str, sample: int, kept: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``kept`` of docs and the new ones, whose names are returned too."""
    weights, odds = fit(docs, labels, label, id_col, text_col, sample)

    def evidence(features):
        import numpy as np
        import pyarrow as pa

        return pa.array(np.clip(features @ np.array(weights), -20, 20))

    name = {c: fresh(f"{c}_", docs.columns) for c in (*NEW, "text", "site")}
    h, p, t, e, site = (name[c] for c in ("host", "path", "text", "evidence", "site"))
    place = [F.coalesce((F.col(d) if c is None else c).cast("string"), F.lit("")) for c, d in ((host, "source"), (path, "lang"))]
    rows = docs.select(*kept, place[0].alias(h), place[1].alias(p), whole_text(text_col).alias(t))
    # Features of whole texts are made once; what they say is kept with each row for the second pass.
    seen = stored(_with_features(rows, t, evidence, e, T.DoubleType()), f"{shared_folder(docs.sparkSession)}/evidence")
    own = _sigmoid(F.col(e) + odds)
    sites, found = site_posteriors(seen.select(F.col(h).alias("host"), F.col(p).alias("path"), own.alias("p")))
    sites = sites.select(F.struct(*sites.columns).alias(site))
    both = seen.join(sites, (F.col(h) == F.col(site)["host"]) & (F.col(p) == F.col(site)["path"]))
    both = both.withColumn(name["site_prior"], prior_without(F.col(site), own, found))
    prior = F.col(name["site_prior"])
    return both.withColumn(name["quality_score"], _sigmoid(F.col(e) + F.log(prior / (1 - prior)))), name


def drop_low_quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE_TEXTS) -> DataFrame:
    """The rows that quality accepts, with the columns of docs."""
    scored, name = _scored(docs, labels, host, path, label, id_col, text_col, sample, docs.columns)
    return scored.filter(F.col(name["quality_score"]) >= threshold).select(*docs.columns)
