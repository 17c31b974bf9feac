"""k-mers by functions of plain SQL: whole sequences at once, and products that wrap."""

import random

from compare import DATA
from pyspark.sql import functions as F
from test_shuffles import shuffles

from kelpwood.functions import kmers as km
from kelpwood.functions.sql import register
from kelpwood.plans import registry


def test_blocks_hold_the_kmers_of_their_sequence(spark):
    register(spark)
    pick = random.Random(6)
    seqs = ["".join(pick.choice("ACGTUacgtuN") for _ in range(n)) for n in (0, 4, 5, 20, 21, 22, 30, 31, 32, 33, 42, 128, 500)] + ["é" * 40, None]
    spark.createDataFrame(list(enumerate(seqs)), "i int, seq string").createOrReplaceTempView("sequences_of_blocks")
    for k in (1, 5, 21, 31):
        want = sorted(map(tuple, spark.sql(f"SELECT i, kmer_key(kmer) FROM sequences_of_blocks, LATERAL kmers(seq, {k})").collect()))
        got = spark.sql(f"SELECT i, block_key(b, j, {k}) FROM (SELECT i, kmer_blocks(seq, {k}) AS bs FROM sequences_of_blocks) LATERAL VIEW explode(bs) AS b LATERAL VIEW explode(sequence(0, b.n - 1)) AS j")
        assert want and sorted(map(tuple, got.collect())) == want


def test_the_mix_hash_wraps_whatever_the_session_says(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    pick = random.Random(7)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(pick.getrandbits(64) - 2**63 for _ in range(500))]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            register(spark)
            assert spark.conf.get("spark.sql.ansi.enabled") == ansi
            assert df.select(km.hash_key(F.col("key")).alias("a"), F.expr("kmer_mix(key)").alias("b")).filter("a <> b").count() == 0
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_sequences_of_shared_kmers_are_not_joined_with_themselves(spark):
    """By sequence they would be shuffled, and all that are equal would meet in one task."""
    df = registry.QUERIES["sql_shared_kmers"](spark, DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "seq" not in "".join(line for line in plan.splitlines() if "Join" in line) and "transform(array(least" not in plan
    assert shuffles(df) <= 8


def test_keys_come_with_the_kmers_in_one_pass(spark):
    df = registry.QUERIES["rev_hash"](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "lambda" not in plan


def test_kmers_are_the_same_over_the_ends_of_hashed_blocks(monkeypatch):
    import numpy as np

    pick = random.Random(9)
    pieces = ["".join(pick.choice("ACGT") for _ in range(n)).encode() for n in (0, 20, 21, 22, 63, 64, 65, 400, 20, 21)]
    for k in (5, 21):
        got = []
        for size in (1, 7, 64, 1 << 15):
            monkeypatch.setattr(km, "HASHED", size)
            got.append([x.tolist() for x in km.kept_kmers(pieces, k, km.threshold(2))])
        want = [(i, p) for i, s in enumerate(pieces) for p in range(len(s) - k + 1) if km._mixed(km.packed_kmers(km.base_codes()[np.frombuffer(s[p : p + k], np.uint8)], k))[0] < km.threshold(2)]
        assert list(zip(*got[0][:2])) == want and all(g == got[0] for g in got)
    assert [len(x) for x in km.kept_kmers([b"ACGT"], 21, km.threshold(2))] == [0, 0, 0]
