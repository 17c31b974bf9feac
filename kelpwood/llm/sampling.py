"""Bounded samples for the models, and the rows they may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32 of the id as text leaves this remainder are never learned from.
FOLDS, HELD_OUT = 4, 2


def held_out(id_col: str) -> Column:
    """Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def in_sample(id_col: str, rows: int, bound: int) -> Column:
    """True for about ``bound`` of ``rows`` rows, or all if there are no more, chosen by a hash of the id."""
    share = min(1.0, bound / max(1, rows))
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most about ``bound`` labelled documents outside the held-out fold.

    The labels in the sample, and only these, are broadcast: ``bound`` limits their size.
    """
    from .shared import whole_text

    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    n = known.count()
    known = known.filter(in_sample(id_col, n, bound)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("label"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.join(F.broadcast(known), "id")
