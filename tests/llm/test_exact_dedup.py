import hashlib
from collections import defaultdict

import pytest
from edge import no_documents, odd_documents
from pyspark.sql import functions as F

from kelpwood.llm.exact_dedup import build_directory, build_index, drop_copies, exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        ids = [x for x in g if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


KEYS = {"hash": lambda: None, "length": lambda: F.length(F.coalesce("text", F.lit(""))), "one": lambda: F.lit(7)}


@pytest.mark.parametrize("key", KEYS)
@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
def test_odd_documents_under_weak_keys(spark, key, bucket_rows):
    docs = odd_documents(spark)
    out = exact_dedup(docs, key=KEYS[key](), bucket_rows=bucket_rows)
    assert set(docs.columns) <= set(out.columns)
    got = sorted((tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_tell_texts_of_one_key_apart(spark):
    docs = spark.createDataFrame([(i, f"t{i % 5}") for i in range(20)], "doc_id long, text string")
    chains, pointers, _ = build_index(docs, key=F.lit(3), bucket_rows=2)
    index = chains.collect()
    assert sorted(r.chain for r in index) == [0, 1, 2, 3, 4] and len({r.bucket for r in index}) == 1 == pointers.count()
    assert {(r.text, r.keep_id, r.group_size) for r in index} == {(f"t{k}", 15 + k, 4) for k in range(5)}


def test_the_index_decides(spark, monkeypatch):
    """Without its directory no document finds its chain; with another chain in the index it gets that one's id."""
    from kelpwood.llm import exact_dedup as module

    docs = spark.createDataFrame([(i, f"t{i % 5}") for i in range(20)], "doc_id long, text string")
    build = module.build_index

    def without_directory(*a, **k):
        chains, pointers, depth = build(*a, **k)
        return chains, pointers.limit(0), depth

    def other_ids(*a, **k):
        chains, pointers, depth = build(*a, **k)
        return chains.withColumn("keep_id", -F.col("keep_id")), pointers, depth

    monkeypatch.setattr(module, "build_index", without_directory)
    assert {r.group_size for r in module.exact_dedup(docs).collect()} == {1}
    monkeypatch.setattr(module, "build_index", other_ids)
    assert {r.keep_id for r in module.exact_dedup(docs).collect()} == {-15, -16, -17, -18, -19}


def test_a_hot_text_is_combined_before_its_owner_gets_it(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    chains, _, _ = build_index(docs)
    assert [(r.text, r.keep_id, r.group_size) for r in chains.collect()] == [("hot", 29_997, 10_000)]
    assert exact_dedup(docs).filter("kept").count() == 20_001


@pytest.mark.parametrize("bucket_rows", [10, 50])
def test_buckets_hold_no_more_than_they_may(spark, bucket_rows):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    pointers, depth = build_directory(keys, bucket_rows)
    rows = keys.withColumn("prefix", F.shiftrightunsigned("key", 64 - depth)).join(pointers, "prefix")
    sizes = rows.groupBy("bucket").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= bucket_rows and sizes[1] == 2000


def test_skewed_keys_deepen_the_directory_where_they_are(spark):
    keys = spark.range(600).select(F.when(F.col("id") < 500, F.col("id")).otherwise(F.xxhash64("id")).alias("key"))
    pointers, depth = build_directory(keys, 40, full_depth=12)
    rows = keys.withColumn("prefix", F.shiftrightunsigned("key", 64 - depth)).join(pointers, "prefix")
    deep = rows.groupBy("bucket", "local_depth").count().collect()
    assert sum(r["count"] for r in deep) == 600
    assert all(r["count"] <= 40 or r.local_depth == 12 for r in deep) and len({r.local_depth for r in deep}) > 1


def test_empty_table_and_filter(spark):
    assert exact_dedup(no_documents(spark)).count() == 0
    docs = odd_documents(spark)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [2, 2, 4, 5, 6, 7, 8, 9]
