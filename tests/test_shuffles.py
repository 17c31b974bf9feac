"""Sketches and profiles shuffle their rows no more often than they must."""

import random

from pyspark.sql import functions as F

from kelpwood.functions import kmers as km
from kelpwood.operators import contain as ct
from kelpwood.operators import sketch as sk


def shuffles(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(" Exchange " in f" {line.lstrip(' :+-')}" for line in plan.splitlines())


def genomes(spark, seed: int = 3):
    pick = random.Random(seed)
    make = lambda n: "".join(pick.choice("ACGT") for _ in range(n))
    rows = [(g, [make(pick.choice([0, 20, 21, 300, 5000])) for _ in range(pick.randrange(5))]) for g in range(40)]
    rows += [(100, [rows[1][1][0] if rows[1][1] else make(400)] * 2 + [None, make(900)]), (101, [])]
    return spark.createDataFrame(rows, "genome long, seqs array<string>")


def test_genomes_in_one_row_are_sketched_without_a_shuffle(spark):
    rows = genomes(spark)
    contigs = rows.select("genome", F.posexplode("seqs").alias("contig", "seq"))
    for spacing in (0, 30, 400):
        whole = sk.whole_sketch(rows, 21, 20, spacing)
        assert shuffles(whole) == 0
        want = sorted(map(tuple, sk.genome_sketch(contigs, 21, 20, spacing).collect()))
        assert want and sorted(map(tuple, whole.collect())) == want


def test_long_contigs_are_walked_in_blocks(spark, monkeypatch):
    seq = "".join(random.Random(5).choice("ACGT") for _ in range(3 * km.BLOCK_BASES + 17))
    rows = spark.createDataFrame([(1, [seq, seq[:700]]), (2, ["ACGT" * 9, seq[5:90_000]])], "genome long, seqs array<string>")
    contigs = rows.select("genome", F.posexplode("seqs").alias("contig", "seq"))
    assert sorted(map(tuple, sk.whole_sketch(rows).collect())) == sorted(map(tuple, sk.genome_sketch(contigs).collect()))


def test_sequences_are_hashed_without_an_object_each():
    """Their bytes are taken from the column: slices, nulls and other characters are as row by row."""
    import pyarrow as pa

    pick = random.Random(6)
    texts = [None if pick.random() < 0.1 else "".join(pick.choice("ACGTacgtN") for _ in range(pick.choice([0, 20, 21, 90, 300]))) for _ in range(60)] + ["é" * 40 + "ACGT" * 20]
    for start, stop in ((0, 61), (7, 40), (9, 9), (60, 61)):
        column, rows = pa.array(texts, pa.string()).slice(start, stop - start), texts[start:stop]
        data, ends = km.column_bytes(column)
        want = [x.tolist() for x in km.kept_kmers([(t or "").encode() for t in rows], 21, km.threshold(2))]
        for block in (1, 50, 1 << 19):
            parts = [km.kept_between(data, ends, 21, km.threshold(2), low, min(low + block, len(data))) for low in range(0, len(data), block)]
            assert [[v for p in parts for v in p[i].tolist()] for i in range(3)] == want
        assert [c.to_pylist() for c in km.read_fingerprints(column)] == [c.to_pylist() for c in km.read_fingerprints(rows)]


def test_genomes_of_a_batch_are_sketched_some_at_a_time(spark, monkeypatch):
    """Empty and null ones between them, whatever a block holds."""
    rows = genomes(spark, 11).unionByName(spark.createDataFrame([(200, None), (201, [None, ""]), (202, ["ACGTTGCAGGCTAAGCTTGA" * 3])], "genome long, seqs array<string>")).coalesce(1)
    contigs = rows.select("genome", F.posexplode("seqs").alias("contig", "seq"))
    want = sorted(map(tuple, sk.genome_sketch(contigs, 21, 2).collect()))
    assert want and sorted(map(tuple, sk.whole_sketch(rows, 21, 2).collect())) == want


def counted(rows: list, cap: int) -> dict:
    """The rule, one occurrence after another."""
    out, seen = {}, {}
    for sample, h, _, a, b in sorted(rows, key=lambda r: r[2]):
        n, known = out.get((sample, h), 0), seen.setdefault((sample, h), set())
        out[sample, h] = n + (n == 0 or n >= cap or a is None or (a not in known and b not in known and a != b))
        known |= {a, b}
    return out


def test_counts_with_a_cap_take_one_shuffle_whatever_the_batches(spark):
    pick = random.Random(8)
    rows = [(pick.choice(["a", "b", None]), pick.choice([1, 2, 3, pick.randrange(10, 400)]), i, *(pick.choice([(None, None), (pick.randrange(30), pick.randrange(30)), (0, 1)]))) for i in range(3000)]
    occ = spark.createDataFrame(rows, "sample string, h long, occ long, fp0 long, fp1 long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for cap in (1, 4):
                got = sk.sample_sketch(occ, cap=cap)
                assert shuffles(got) == 1
                assert {(r.sample, r.h): r.cnt for r in got.collect()} == counted(rows, cap)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_fingerprints_by_numpy_are_those_of_the_columns(spark):
    pick = random.Random(4)
    reads = ["".join(pick.choice("ACGTUacgtuN") for _ in range(n)) for n in (0, 20, 65, 66, 67, 100, 399, 400, 401)] + ["é" * 80, "AC中GT" * 20]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reads)], "i int, seq string")
    short = F.length("seq") <= 400
    want = [(r.a, r.b) for r in df.select("i", *(F.when(short, f).alias(n) for n, f in zip("ab", km.fingerprints(F.col("seq"))))).orderBy("i").collect()]
    assert list(zip(*(c.to_pylist() for c in km.read_fingerprints(reads)))) == want


def test_contested_kmers_are_shuffled_once(spark):
    """Their genomes' results are joined to them, and each k-mer's genomes meet once."""
    kmers = spark.createDataFrame([(g, h, (g + h) % 3 > 0) for g in range(6) for h in range(40) if (g * h) % 4 < 3], "genome long, h long, used boolean")
    results = spark.createDataFrame([(s, g, 0.95 + (g // 2) / 100) for s in "xy" for g in range(6) if (s, g) != ("y", 5)], "sample string, genome long, final_ani double")
    table = ct.winners(results, kmers)
    for least in (0, 3):
        found = ct.edges(ct.contested(results, kmers), least)
        assert shuffles(found) < shuffles(ct.reassigned(results, kmers, table, least))
        want = sorted(map(tuple, ct.reassigned(results, kmers, table, least).collect()))
        assert want and sorted(map(tuple, found.collect())) == want


def crowd(seed: int):
    """Genomes that share k-mers, some of them tracked, and two samples, as rows."""
    pick = random.Random(seed)
    held = {(g, h): pick.random() < 0.7 for g in range(12) for h in pick.sample(range(60 * (g // 4), 60 * (g // 4) + 160), 90)}
    held |= {(12, h): h < 20 for h in range(25)}
    counts = [(s, h, pick.choice([0, 1, 1, 2, 2, 3, 5])) for s in "xy" for h in range(400) if pick.random() < 0.9]
    return [(g, h, u) for (g, h), u in held.items()], counts


def test_profiles_move_again_only_what_genomes_share(spark):
    """The two passes are those of the tables of all k-mers; what one genome holds alone has no hash any more."""
    for seed in (1, 2, 3):
        held, counts = crowd(seed)
        plain = spark.createDataFrame(held, "genome long, h long, used boolean")
        n = {g: sum(u for a, _, u in held if a == g) for g in range(13)}
        sized = spark.createDataFrame([(*r, n[r[0]]) for r in held], "genome long, h long, used boolean, n_kmers long")
        samples = spark.createDataFrame(counts, "sample string, h long, cnt long")
        bases = spark.createDataFrame([(g, 1000 + g) for g in range(13)], "genome long, gn_size long")
        pairs, sizes = ct.histogram(plain, samples, 30)
        first = ct.identities(ct.coverage(pairs, sizes, 21), 21, min_ani=0.95)
        mine = ct.contested(first, plain).filter("used").join(samples.filter("cnt > 0"), ["sample", "h"])
        own = mine.filter("winner = genome").groupBy("sample", "genome", "cnt").count().withColumnRenamed("count", "n")
        second = {(r.sample, r.genome): r for r in ct.identities(ct.coverage(own, sizes, 21), 21, min_ani=0.95).collect()}
        before = {(r.sample, r.genome): r.contained for r in first.collect()}
        lost = {(r.sample, r.genome): r["count"] for r in mine.filter("winner <> genome").groupBy("sample", "genome").count().collect()}
        want = sorted((*p, r.contained, r.n_kmers, lost.get(p, 0), r.final_ani) for p, r in second.items() if p in before and before[p] - r.contained < 0.99**21 * r.n_kmers)
        assert want and any(w[4] for w in want)
        for table in (plain, sized):
            got = ct.profile(table, samples, bases, 21, min_kmers=30)
            assert sorted((r.sample, r.genome, r.contained, r.n_kmers, r.kmers_lost, r.final_ani) for r in got.collect()) == want
        holders = {h: sum(a != 12 for a, b, _ in held if b == h) for h in range(400)}
        assert {r.h for r in ct.met(sized, samples, 30).collect()} == {None} | {h for _, h, c in counts if c and holders[h] > 1}
        again, none = ct.histogram(sized, samples, 30)
        assert none is None and shuffles(again) < shuffles(pairs)
        assert sorted(map(tuple, again.select("sample", "genome", "cnt", "n").collect())) == sorted(map(tuple, pairs.select("sample", "genome", "cnt", "n").collect()))


def test_sketches_tell_how_many_kmers_a_genome_uses(spark):
    rows = genomes(spark)
    got = sk.whole_sketch(rows, sizes=True)
    assert shuffles(got) == 0
    n = {r.genome: r.n for r in sk.whole_sketch(rows).groupBy("genome").agg(F.count_if("used").alias("n")).collect()}
    assert n and {(r.genome, r.n_kmers) for r in got.collect()} == set(n.items())


def test_parts_that_are_hashed_by_genome_are_merged(spark):
    """Large parts come from joins by shuffles, which hash both by genome."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "-1")
        kmers = spark.range(60_000).select((F.col("id") % 300).alias("genome"), F.col("id").alias("h"), (F.col("id") % 2 == 0).alias("used"))
        pick = lambda c: kmers.join(spark.range(300).withColumnRenamed("id", "genome").filter(c), "genome", "left_semi")
        parts = [("a", pick("genome % 3 = 0")), ("b", pick("genome % 2 = 0"))]
        got = {(r.part, r.genome): r["count"] for r in sk.merge_sketches(*parts).groupBy("part", "genome").count().collect()}
        assert got == {("a" if g % 3 == 0 else "b", g): 200 for g in range(300) if g % 3 == 0 or g % 2 == 0}
        tables = [df.withColumns({"part": F.lit(n), "k": F.lit(21), "c": F.lit(20), "min_spacing": F.lit(30)}) for n, df in parts]
        row = sk.audit_settings(tables[0].unionByName(tables[1])).first()
        assert (row.sketches, row.duplicate_names) == (250, 50)
    finally:
        for n, v in zip(names, before):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
