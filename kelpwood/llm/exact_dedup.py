"""Exact deduplication over an extendible-hash index kept on shared files.

Main path, DataFrame operations only:

1. Every text is hashed to a 64-bit key. Slots are the distinct keys, with the
   number of rows and the largest id; they are counted without their texts.
2. A directory of key prefixes starts small and doubles: a bucket with more
   than ``bucket_rows`` slots splits on the next bit of the key, until every
   bucket fits or the directory is at its full depth.
3. A key that one row has needs no comparison. The rows of all other keys find
   their bucket by the directory, and bring their texts: rows of equal bytes are
   combined in the tasks that read them, then in some parts of each hot key,
   and go to the owner tasks, which hold contiguous ranges of (bucket, key).
   There texts under one key form a chain, told apart by their bytes: each link
   has its text, the id that stays and the number of rows. Chains are written to
   the shared folder in the order of buckets and keys.
4. Documents go the same way from key to prefix, bucket and chain, and are
   compared with a link's text by their bytes. Those that find no chain are the
   only rows of their keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, shared_folder, stored, whole_text

#: Prefix bits beyond the depth at which mean buckets are full: room for doubling.
SPARE_BITS = 6
#: Parts that the rows of one text are combined in before its owner gets them.
SALTS = 16


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def build_directory(keys: DataFrame, bucket_rows: int, full_depth: int | None = None) -> tuple[DataFrame, int]:
    """The directory of a table with a bigint column ``key``.

    Returns (pointers, depth). Pointers has one row per prefix of ``depth`` bits
    that occurs: prefix, bucket (first prefix that the bucket covers) and
    local_depth. Buckets with more than ``bucket_rows`` rows were split, unless
    they are as deep as the directory can get: equal keys can't be parted.
    """
    n = max(1, keys.count())
    start = max(0, math.ceil(math.log2(max(1.0, n / bucket_rows))) - 1)
    depth = full_depth if full_depth is not None else min(40, start + SPARE_BITS)
    start = min(start, depth)
    folder = shared_folder(keys.sparkSession)
    left = stored(keys.groupBy(_prefix(F.col("key"), depth).alias("prefix")).agg(F.count(F.lit(1)).alias("rows")), f"{folder}/histogram")
    closed = None
    for bits in range(start, depth + 1):
        covers = F.shiftleft(F.shiftrightunsigned(F.col("prefix"), depth - bits), depth - bits)
        sized = left.withColumn("bucket", covers)
        full = sized.groupBy("bucket").agg(F.sum("rows").alias("bucket_size"))
        sized = sized.join(full, "bucket")
        fits = F.lit(True) if bits == depth else F.col("bucket_size") <= bucket_rows
        done = sized.filter(fits).select("prefix", "bucket", F.lit(bits).alias("local_depth"))
        closed = done if closed is None else closed.unionByName(done)
        if bits == depth:
            break
        left = stored(sized.filter(~fits).select("prefix", "rows"), f"{folder}/level={bits}")
        if left.isEmpty():
            break
    return stored(closed, f"{folder}/directory"), depth


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, bucket_rows: int = 1 << 16, full_depth: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(chains, pointers, depth) of the texts of docs.

    Chains has one row for each distinct text whose key occurs more than once:
    bucket, local_depth, key, chain (its place among the texts that share the
    key, from 0), text, keep_id, group_size. Keys of one row are in no chain.
    """
    text = whole_text(text_col)
    key = F.xxhash64(text) if key is None else key.cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), key.alias("key"))
    folder = shared_folder(docs.sparkSession)
    slots = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), f"{folder}/slots")
    pointers, depth = build_directory(slots.select("key"), bucket_rows, full_depth)
    crowded = stored(slots.filter("rows > 1").withColumn("prefix", _prefix(F.col("key"), depth)).join(pointers, "prefix").select("bucket", "local_depth", "key"), f"{folder}/crowded")
    parts = rows.join(crowded, "key").groupBy("bucket", "local_depth", "key", "text", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    parts = parts.agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Ranges of (bucket, key) are whole buckets and keys: neither the grouping nor the window moves a row again.
    owned = parts.repartitionByRange("bucket", "key").groupBy("bucket", "key", "text").agg(F.first("local_depth").alias("local_depth"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    place = F.row_number().over(Window.partitionBy("bucket", "key").orderBy(F.desc("keep_id"), "text")) - 1
    chains = owned.withColumn("chain", place.cast("int")).select("bucket", "local_depth", "key", "chain", "text", "keep_id", "group_size")
    return stored(chains, f"{folder}/chains"), pointers, depth


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, bucket_rows: int = 1 << 16, full_depth: int | None = None) -> DataFrame:
    """Mark, for every row, which row of its group of equal texts stays.

    Returns all columns of docs and keep_id, group_size, kept, text_sha256
    (any columns of docs with these names are replaced).

    Defined results: a null text equals the empty text; of equal texts the row
    with the largest id stays, a null id being smaller than any other; rows
    repeated with the same id are one document and are kept or dropped
    together; an empty table gives an empty table; other columns pass through
    whatever they hold. ``key`` replaces the hash (tests use weak ones): any
    bigint expression over docs that is equal for equal texts is right.
    """
    out = ["keep_id", "group_size", "kept", "text_sha256"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in out])
    k, t, prefix, b = (fresh(x, docs.columns) for x in ("key_", "whole_", "prefix_", "bucket_"))
    chains, pointers, depth = build_index(docs, id_col, text_col, key, bucket_rows, full_depth)
    marked = docs.withColumns({k: F.xxhash64(whole_text(text_col)) if key is None else key.cast("long"), t: whole_text(text_col)})
    marked = marked.withColumn(prefix, _prefix(F.col(k), depth)).join(pointers.select(F.col("prefix").alias(prefix), F.col("bucket").alias(b)), prefix, "left")
    # Most documents find no chain. A hot key's documents may be split between tasks: each key has few links.
    lb, lk, lt = (fresh(x, marked.columns) for x in ("linkbucket_", "linkkey_", "linktext_"))
    links = chains.select(F.col("bucket").alias(lb), F.col("key").alias(lk), F.col("text").alias(lt), "keep_id", "group_size")
    found = marked.join(links, (F.col(b) == F.col(lb)) & (F.col(k) == F.col(lk)) & (F.col(t) == F.col(lt)), "left")
    own = F.col(id_col).cast("long")
    keep = F.when(F.col("group_size").isNull(), own).otherwise(F.col("keep_id"))
    found = found.withColumns({"keep_id": keep, "group_size": F.coalesce("group_size", F.lit(1)).cast("long"), "text_sha256": F.sha2(t, 256)})
    return found.select(*docs.columns, "keep_id", "group_size", own.eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that exact_dedup keeps, with the columns of docs."""
    return exact_dedup(docs, id_col, text_col, **options).filter("kept").select(*docs.columns)
