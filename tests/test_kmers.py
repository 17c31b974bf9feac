import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpwood.functions import kmers as km
from kelpwood.operators import contain as ct
from kelpwood.operators import sketch as sk

M = (1 << 64) - 1
CODE = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 3}


def slow_hash(x):
    x = ~(x + (x << 21)) & M
    x ^= x >> 24
    x = (x + (x << 3) + (x << 8)) & M
    x ^= x >> 14
    x = (x + (x << 2) + (x << 4)) & M
    x ^= x >> 28
    return (x + (x << 31)) & M


def slow_kmers(seq, k, c):
    codes = [CODE.get(b.upper(), 0) for b in seq]
    out = []
    for p in range(len(codes) - k + 1):
        w = codes[p : p + k]
        f = sum(b << 2 * (k - 1 - i) for i, b in enumerate(w))
        r = sum((3 - b) << 2 * i for i, b in enumerate(w))
        if (h := slow_hash(min(f, r))) < km.threshold(c):
            out.append((p, h))
    return out


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_hash_forms_agree_and_invert(spark):
    r = random.Random(1)
    keys = [0, 1, (1 << 62) - 1, *(r.randrange(1 << 62) for _ in range(200))]
    want = [slow_hash(k) for k in keys]
    assert km._mixed(np.array(keys, np.uint64)).tolist() == want
    assert km.unmixed(np.array(want, np.uint64)).tolist() == keys
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", km.hash_key(F.col("k")).alias("h"))
    assert {(x.k, x.h) for x in df.collect()} == {(k, signed(h)) for k, h in zip(keys, want)}


@pytest.mark.parametrize("k", [21, 31])
@pytest.mark.parametrize("parts", [1, 4, 17])
def test_kmers_of_any_sequence_and_partitioning(spark, k, parts):
    r = random.Random(k)
    seqs = ["", "ACG", None, "N" * 40, "acgtu" * 20, *("".join(r.choice("ACGTNacgt") for _ in range(r.randrange(10, 300))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(seqs)), "i long, seq string").repartition(parts)
    got = {tuple(x) for x in km.explode_kmers(df, k, 5).collect()}
    assert got == {(i, p, h) for i, s in enumerate(seqs) if s for p, h in slow_kmers(s, k, 5)}


def test_fingerprints_need_length(spark):
    df = spark.createDataFrame([("A" * 65,), ("ACGT" * 20,)], "s string")
    a, b = km.fingerprints(F.col("s"))
    rows = df.select(a, b).collect()
    assert rows[0][0] is None and rows[0][1] is None
    s = "ACGT" * 20
    packed = lambda bases: signed(sum(CODE[b] << 2 * (31 - i) for i, b in enumerate(bases)))
    assert rows[1][0] == packed(s[0:32:2] + s[40:72:2]) and rows[1][1] == packed(s[1:32:2] + s[41:73:2])


@pytest.mark.parametrize("cap", [None, 4])
def test_counts_equal_the_sequential_rule(spark, cap):
    r = random.Random(5)
    rows, want = [], {}
    for h in range(150):
        seen, count = set(), 0
        for occ in range(r.randrange(1, 14)):
            fps = (None, None) if r.random() < 0.15 else (f"f{r.randrange(7)}", f"f{r.randrange(7)}")
            rows.append(("s", h, (occ, 0, 0), *fps))
            duplicate = False
            if (cap is None or count < cap) and fps[0] is not None:
                for fp in fps:
                    if fp in seen:
                        duplicate |= count > 0
                    else:
                        seen.add(fp)
            count += not duplicate
        want[h] = count
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "sample string, h long, occ struct<idx:long,mate:int,pos:int>, fp0 string, fp1 string")
    assert {x.h: x.cnt for x in sk.sample_sketch(df, cap=cap).collect()} == want


def test_spacing_equals_the_sequential_rule(spark):
    r = random.Random(3)
    rows, want = [], set()
    for g in range(20):
        for contig in range(3):
            last = None
            for p in sorted(r.sample(range(200), r.randrange(0, 40))):
                h = r.randrange(1 << 50)
                rows.append((g, contig, p, h))
                used = last is None or last == 0 or p - last > 30
                last = p if used else last
                want.add((g, contig, p, h, used))
    df = spark.createDataFrame(rows, "genome long, contig int, pos int, h long")
    assert {tuple(x) for x in sk.spaced_kmers(df).collect()} == want


def test_poisson_cuts():
    cuts = ct.poisson_cuts()
    assert [cuts[m] for m in (1, 2, 3, 5, 10, 20, 29)] == [11, 15, 18, 24, 35, 53, 68]


def coverage_of(spark, counts, n_kmers):
    pairs = spark.createDataFrame([("s", 1, c, n) for c, n in counts.items()], "sample string, genome long, cnt long, n long")
    return ct.coverage(pairs, spark.createDataFrame([(1, n_kmers)], "genome long, n_kmers long"), 21)


@pytest.mark.parametrize(("counts", "median"), [({1: 5, 2: 5}, 2), ({4: 1}, 4), ({1: 3, 2: 2}, 1), ({15: 2, 16: 2}, 16)])
def test_median_is_the_upper_one(spark, counts, median):
    assert coverage_of(spark, counts, 100).first()["median"] == median


@pytest.mark.parametrize(("counts", "lam"), [({1: 30, 2: 10}, 10 / 30 * 2), ({1: 20, 2: 20, 3: 5}, 5 / 20 * 3), ({1: 40}, None), ({1: 10, 2: 5}, None), ({1: 30, 3: 10}, None), ({1: 30, 2: 2}, None)])
def test_ratio_estimator(spark, counts, lam):
    got = coverage_of(spark, counts, 200).select(ct.lambda_ratio()).first()[0]
    assert got == (pytest.approx(lam) if lam is not None else None)


def test_outliers_are_cut(spark):
    row = coverage_of(spark, {1: 50, 11: 1, 12: 1}, 100).first()
    assert (row["kept"], row["contained"], row["total"]) == (51, 52, 61)


def test_bootstrap_holds_its_estimate(spark):
    from kelpwood.operators.bootstrap import intervals

    row = intervals(coverage_of(spark, {1: 600, 2: 200, 3: 40}, 2000), 21).first()
    assert row["lambda_low"] < 2 * 200 / 600 < row["lambda_high"]
    assert intervals(coverage_of(spark, {1: 3}, 100), 21).first()["lambda_low"] is None


def test_merge_keeps_the_first_of_a_genome(spark):
    a = spark.createDataFrame([(1, 10, True)], "genome long, h long, used boolean")
    b = spark.createDataFrame([(1, 11, True), (2, 12, False)], "genome long, h long, used boolean")
    assert {tuple(x) for x in sk.merge_sketches(("a", a), ("b", b)).collect()} == {("a", 1, 10, True), ("b", 2, 12, False)}


def test_a_database_of_other_settings_is_refused(spark, tmp_path):
    from kelpwood.sources.stores import read_sketch, write_sketch

    write_sketch(spark.createDataFrame([(1, 10, True)], "genome long, h long, used boolean"), str(tmp_path / "db"), 21, 20, 30)
    assert read_sketch(spark, str(tmp_path / "db"), 21, 40).count() == 1
    for k, c in ((31, 20), (21, 10)):
        with pytest.raises(ValueError, match="can't serve"):
            read_sketch(spark, str(tmp_path / "db"), k, c)


def test_long_sequences_are_hashed_in_blocks(spark):
    r = np.random.default_rng(4)
    seq = "".join(np.array(list("ACGT"))[r.integers(0, 4, 1_200_000)])
    codes = np.array([CODE[b] for b in seq], np.uint64)
    h = km._mixed(km.packed_kmers(codes, 21))
    at = np.flatnonzero(h < np.uint64(km.threshold(200)))
    df = spark.createDataFrame([(1, "ACGT"), (2, seq), (3, seq[:30])], "i long, seq string")
    got = sorted((x.pos, x.h) for x in km.explode_kmers(df, 21, 200).filter("i = 2").collect())
    assert got == list(zip(at.tolist(), h[at].view(np.int64).tolist()))


def test_a_long_contig_is_walked_in_time(spark):
    import time

    df = spark.range(250_000).select(F.lit(1).alias("genome"), F.lit(0).alias("contig"), (F.col("id") * 20).cast("int").alias("pos"), F.xxhash64("id").alias("h"))
    sk.spaced_kmers(df.limit(10)).count()
    start = time.time()
    used = sk.spaced_kmers(df, 30).filter("used").agg(F.count(F.lit(1)), F.max("pos")).first()
    assert tuple(used) == (125_001, 249_999 * 20) and time.time() - start < 10


def test_a_hot_kmer_is_counted_by_the_sequential_rule(spark):
    n = 60_000
    hot = spark.range(n).select(F.lit("s").alias("sample"), F.lit(7).cast("long").alias("h"), F.col("id").alias("occ"), (F.col("id") % 3).alias("fp0"), (F.col("id") % 5 + 10).alias("fp1"))
    # Fresh are occurrences 0, 1 and 2 (both fingerprints new); the count stays at 3, below the cap.
    assert sk.sample_sketch(hot, cap=4).first().cnt == 3 == sk.sample_sketch(hot).first().cnt
    short = hot.withColumns({"fp0": F.when(F.col("occ") % 1000 != 0, F.col("fp0")), "fp1": F.when(F.col("occ") % 1000 != 0, F.col("fp1"))})
    seen, count = set(), 0
    for occ in range(n):
        fps = () if occ % 1000 == 0 else (occ % 3, occ % 5 + 10)
        duplicate = count < 4 and count > 0 and any(f in seen for f in fps)
        seen |= set(fps)
        count += not duplicate
    assert sk.sample_sketch(short, cap=4).first().cnt == count


@pytest.mark.parametrize(("name", "key", "mate"), [
    ("a_1.fastq", "a", 1), ("a.R2.fq.gz", "a", 2), ("a-r1.FNQ", "a", 1), ("s_1_2.fq", "s_2", 1), ("a_1.clean.fq.gz", "a.clean", 1), ("a_2.raw.fq.gz", "a.raw", 2),
    ("_1.fq", None, None), ("1.fq", None, None), ("a_3.fq", None, None), ("a_1.fa", None, None), ("a1.fq", None, None), ("a__1.fq", "a_", 1), ("a_1__x.fq", None, None), ("x_R1_001.fastq.gz", "x_001", 1),
])
def test_mates_by_the_parts_of_their_names(spark, name, key, mate):
    from kelpwood.functions.names import mate_key

    k, m = mate_key(F.col("n"))
    assert tuple(spark.createDataFrame([(name,)], "n string").select(k, m).first()) == (key, mate)
