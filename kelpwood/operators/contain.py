"""Containment of genomes in samples: coverage statistics, identity and profiles.

All statistics of a (sample, genome) pair come from its histogram of counts
(sample, genome, cnt, n), which is small; k-mers are joined once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.workers import map_arrow

# Fixed values of the statistics.
CUTOFF = 0.9999999999
LEAST_SAMPLE = 25
MEDIAN_FOR_LAMBDA = 2
MEDIAN_FOR_MEAN = 15
MEDIAN_FOR_IDENTITY = 3
#: Counts of a block over which the moving median is walked.
MEDIAN_BLOCK = 65_536

PAIR = ["sample", "genome"]


def poisson_cuts() -> dict[int, int]:
    """For each median below 30, the largest count that isn't an outlier."""
    cuts = {}
    for median in range(1, 30):
        total, term, count = 0.0, math.exp(-median), 0
        while total + term < CUTOFF:
            total += term
            count += 1
            term *= median / count
        cuts[median] = count - 1
    return cuts


def histogram(genome_kmers: DataFrame, sample_kmers: DataFrame, min_kmers: int = 50) -> tuple[DataFrame, DataFrame | None]:
    """(pairs, sizes): counts of each genome's used k-mers in each sample as
    (sample, genome, cnt, n), and the genomes large enough (genome, n_kmers).

    Genome k-mers that have n_kmers are read once, and give pairs that have it too
    and no sizes.
    """
    used = genome_kmers.filter("used")
    if "n_kmers" in used.columns:
        found = used.filter(F.col("n_kmers") >= min_kmers).select("genome", "h", "n_kmers").join(sample_kmers.filter("cnt > 0"), "h")
        return found.groupBy("sample", "genome", "cnt").agg(F.count(F.lit(1)).alias("n"), F.first("n_kmers").alias("n_kmers")), None
    sizes = used.groupBy("genome").agg(F.count(F.lit(1)).alias("n_kmers")).filter(F.col("n_kmers") >= min_kmers)
    found = used.select("genome", "h").join(sample_kmers.filter("cnt > 0"), "h")
    # Genomes that are too small go after the counts are summed, when there are fewer rows to move.
    return found.groupBy("sample", "genome", "cnt").agg(F.count(F.lit(1)).alias("n")).join(sizes, "genome", "left_semi"), sizes


def _sums(rows: DataFrame, sizes: DataFrame | None, *columns: Column) -> DataFrame:
    """Columns of each pair, and n_kmers from the rows or from sizes."""
    if sizes is None:
        return rows.groupBy(*PAIR).agg(*columns, F.first("n_kmers").alias("n_kmers"))
    return rows.groupBy(*PAIR).agg(*columns).join(sizes, "genome")


def containment(pairs: DataFrame, sizes: DataFrame | None, k: int) -> DataFrame:
    """(sample, genome, contained, n_kmers, naive_ani)."""
    sums = _sums(pairs, sizes, F.sum("n").alias("contained"))
    return sums.select(*PAIR, "contained", "n_kmers", F.pow(F.col("contained") / F.col("n_kmers"), F.lit(1 / k)).alias("naive_ani"))


def coverage(pairs: DataFrame, sizes: DataFrame | None, k: int) -> DataFrame:
    """Containment with median (the upper one), the outlier cut, and sums over what
    it leaves: kept (k-mers), total (their counts), squares, distinct counts."""
    up_to = Window.partitionBy(*PAIR).orderBy("cnt")
    whole = Window.partitionBy(*PAIR)
    ranked = pairs.withColumns({"upto": F.sum("n").over(up_to), "contained": F.sum("n").over(whole)})
    # The element at place contained / 2 of the sorted counts, from 0.
    median = F.min(F.when(F.col("upto") > F.floor(F.col("contained") / 2), F.col("cnt"))).over(whole)
    cuts = poisson_cuts()
    cut = F.lit(None).cast("long")
    for m, most in cuts.items():
        cut = F.when(F.col("median") == m, F.lit(most)).otherwise(cut)
    marked = ranked.withColumn("median", median).withColumn("keep", F.coalesce(F.col("cnt") <= cut, F.lit(True)))
    kept = lambda x: F.sum(F.when(F.col("keep"), x).otherwise(0))
    sums = _sums(
        marked, sizes, F.first("median").alias("median"), F.first("contained").alias("contained"), kept(F.col("n")).alias("kept"), kept(F.col("n") * F.col("cnt")).alias("total"),
        kept(F.col("n") * F.col("cnt") * F.col("cnt")).alias("squares"), F.count_if("keep").alias("distinct"),
        F.collect_list(F.when(F.col("keep"), F.struct("cnt", "n"))).alias("hist"),
    )
    zeros = F.col("n_kmers") - F.col("contained")
    sums = sums.withColumns({"zeros": zeros, "full": zeros + F.col("kept")})
    mean = F.col("total") / F.col("full")
    return sums.withColumns({
        "naive_ani": F.pow(F.col("contained") / F.col("n_kmers"), F.lit(1 / k)),
        "mean_cov": mean,
        "mean_cov_geq1": F.col("total") / F.col("contained"),
        "variance": (F.col("squares") - F.col("total") * mean) / F.col("full"),
    })


def _informative() -> Column:
    return (F.col("distinct") != 1) & (F.col("kept") >= LEAST_SAMPLE)


def lambda_ratio(min_count: float = 3.0) -> Column:
    """From a coverage row: the most frequent count m (the larger of equals) and
    m + 1 must both be frequent enough; then n(m+1) / n(m) * (m+1)."""
    hist = F.col("hist")
    mode = F.array_max(F.transform(hist, lambda x: F.struct(x["n"].alias("n"), x["cnt"].alias("cnt"))))
    following = F.filter(hist, lambda x: x["cnt"] == mode["cnt"] + 1)
    n1 = F.try_element_at(following, F.lit(1))["n"]
    enough = _informative() & (n1 >= min_count) & (mode["n"] >= min_count)
    return F.when(enough, n1 / mode["n"] * (mode["cnt"] + 1))


def lambda_moments() -> Column:
    """Variance / mean + mean - 1, where that isn't negative."""
    value = F.col("variance") / F.col("mean_cov") + F.col("mean_cov") - 1
    return F.when(_informative() & (value >= 0), value)


def with_lambda_zip(rows: DataFrame, steps: int = 1000) -> DataFrame:
    """Coverage rows with lambda_zip: zero-inflated Poisson by Newton's method; the
    share of zeros is in single precision. All rows of a batch take a step at once."""
    schema = T.StructType([*rows.schema.fields, T.StructField("lambda_zip", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            zeros, full, mean, distinct, kept = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("zeros", "full", "mean_cov", "distinct", "kept"))
            with np.errstate(all="ignore"):
                rest = 1 - (zeros / full).astype(np.float32).astype(float)
                x = mean / rest
                for _ in range(steps):
                    e = np.exp(-x)
                    x = x - (rest * x - mean * (1 - e)) / (rest - mean * e)
                good = (distinct != 1) & (kept >= LEAST_SAMPLE) & (x >= 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, mask=~good)], names=schema.fieldNames())

    return map_arrow(rows, run, schema)


def lambda_negative_binomial(rows: DataFrame, points: int = 10_000) -> DataFrame:
    """Coverage rows to (sample, genome, lambda): the point of a grid around the
    mean whose expected ratio of twos to ones is next to the observed one.

    The expectation changes its form where r reaches 100, as published.
    """
    at = lambda v: F.coalesce(F.try_element_at(F.filter("hist", lambda x: x["cnt"] == v), F.lit(1))["n"], F.lit(0))
    observed = rows.filter(at(1) > 0).select(*PAIR, "mean_cov", "variance", (at(2) / at(1)).alias("observed"))
    schema = T.StructType([f for f in observed.schema.fields if f.name in PAIR] + [T.StructField("lambda", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        steps = np.arange(points, dtype=np.float64)
        for batch in batches:
            out = np.full(batch.num_rows, np.nan)
            columns = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            with np.errstate(all="ignore"):
                for i, (mean, variance, ratio) in enumerate(zip(*columns)):
                    lo, hi = max(0.003, mean - 2), mean + 5
                    x = (hi - lo) / float(points) * steps + lo
                    r = x / (variance - 1 + x + mean)
                    off = np.abs(np.where(r < 100, (r + 1) / 2, (r + 2) / 2) * x / (r + x) - ratio)
                    off[~(r >= 0) | np.isnan(off)] = np.inf
                    if off.min() < 10_000:
                        out[i] = x[off.argmin()]
            found = np.flatnonzero(~np.isnan(out))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(found)) for k in (0, 1)), pa.array(out[found])], names=schema.fieldNames())

    return map_arrow(observed, run, schema)


def adjusted_ani(lam: Column, k: int) -> Column:
    """Identity if the share of contained k-mers is corrected for coverage lam."""
    value = F.pow(F.col("kept") / (1 - F.exp(-lam)) / F.col("full"), F.lit(1 / k))
    return F.when(~F.isnan(value), value)


def identities(rows: DataFrame, k: int, estimator: Column | None = None, min_ani: float = 0.90, mean_coverage: bool = False, adjust: bool = True) -> DataFrame:
    """Coverage rows to results: lambda and its status, final_cov, final_ani, of
    the pairs with an identity of min_ani at least."""
    estimate = lambda_ratio() if estimator is None else estimator
    rows = rows.withColumn("lambda", F.when(F.col("median") <= MEDIAN_FOR_LAMBDA, estimate))
    status = F.when(F.col("median") > MEDIAN_FOR_LAMBDA, "high").when(F.col("lambda").isNull(), "low").otherwise("lambda")
    deep = F.col("mean_cov_geq1") if mean_coverage else F.col("median").cast("double")
    cov = F.coalesce("lambda", F.when(F.col("median") < MEDIAN_FOR_MEAN, F.col("mean_cov_geq1")).otherwise(deep))
    ani = F.coalesce(adjusted_ani(F.col("lambda"), k), F.col("naive_ani")) if adjust else F.col("naive_ani")
    return rows.withColumns({"lambda_status": status, "final_cov": cov, "final_ani": ani}).filter(F.col("final_ani") >= min_ani)


def winners(results: DataFrame, genome_kmers: DataFrame) -> DataFrame:
    """(sample, h, winner): of the genomes in a sample's results that hold a
    k-mer, used or tracked, the one with the highest identity; the smallest
    genome of equals."""
    held = genome_kmers.join(results.select(*PAIR, "final_ani"), "genome")
    best = held.groupBy("sample", "h").agg(F.min(F.struct((-F.col("final_ani")).alias("ani"), F.col("genome"))).alias("best"))
    return best.select("sample", "h", F.col("best.genome").alias("winner"))


def contested(results: DataFrame, genome_kmers: DataFrame) -> DataFrame:
    """(sample, h, genome, used, winner): the k-mers of the genomes in a sample's
    results, each next to its winner. Rows are shuffled once, by k-mer."""
    held = genome_kmers.join(results.select(*PAIR, "final_ani"), "genome").select("sample", "h", "genome", "used", "final_ani")
    best = Window.partitionBy("sample", "h").orderBy(F.desc("final_ani"), "genome")
    return held.withColumn("winner", F.first("genome").over(best)).drop("final_ani")


def edges(rows: DataFrame, least: int = 10) -> DataFrame:
    """reassigned() from contested k-mers."""
    lost = rows.filter("used and winner <> genome")
    return lost.groupBy("sample", "winner", F.col("genome").alias("loser")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)


def reassigned(results: DataFrame, genome_kmers: DataFrame, table: DataFrame, least: int = 10) -> DataFrame:
    """Edges (sample, winner, loser, n): more than ``least`` used k-mers of the
    loser went to the winner."""
    own = genome_kmers.filter("used").join(results.select(*PAIR), "genome")
    lost = own.join(table, ["sample", "h"]).filter("winner <> genome")
    return lost.groupBy("sample", "winner", F.col("genome").alias("loser")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)


def met(genome_kmers: DataFrame, sample_kmers: DataFrame, min_kmers: int = 50) -> DataFrame:
    """(sample, genome, cnt, n_kmers, h): the k-mers that genomes large enough share
    with samples, used ones and those that another genome holds too. Those that are
    only tracked have no n_kmers. What a genome holds alone nobody contests: it
    stands without its hash from here on.

    Both tables are shuffled once, by k-mer.
    """
    rows = genome_kmers
    if "n_kmers" not in rows.columns:
        rows = rows.join(rows.filter("used").groupBy("genome").agg(F.count(F.lit(1)).alias("n_kmers")), "genome")
    rows = rows.filter(F.col("n_kmers") >= min_kmers).select("genome", "h", F.when(F.col("used"), F.col("n_kmers")).alias("n_kmers"))
    shared = rows.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("h")) > 1).filter("shared or n_kmers is not null")
    found = shared.join(sample_kmers.filter("cnt > 0"), "h")
    return found.select(*PAIR, "cnt", "n_kmers", F.when(F.col("shared"), F.col("h")).alias("h"))


def profile(genome_kmers: DataFrame, sample_kmers: DataFrame, sizes_bp: DataFrame, k: int, min_ani: float = 0.95, min_kmers: int = 50, redundant: float = 99.0, estimator: Column | None = None, keep=lambda df: df, within: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """The two passes: identities, k-mers to their winners, identities again over
    what each genome has left, and shares of the sample. Genomes that lost
    (redundant / 100)^k of their k-mers or more are left out. ``keep`` may store
    what is used several times; ``within`` has the pairs (sample, genome) that are
    looked for, all without it; ``first`` is the first pass, where it is there already.

    Only k-mers that several genomes hold are shuffled again, to find their winners."""
    rows = keep(met(genome_kmers, sample_kmers, min_kmers))
    size = F.first("n_kmers").alias("n_kmers")
    # Of n k-mers ``alone`` are held by no other genome.
    pairs = rows.filter("n_kmers is not null").groupBy(*PAIR, "cnt").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("h").isNull()).alias("alone"), size)
    if within is not None:
        pairs = pairs.join(within.select(*PAIR).distinct(), PAIR, "left_semi")
    pairs = keep(pairs)
    if first is None:
        first = keep(identities(coverage(pairs, None, k), k, estimator, min_ani).select(*PAIR, "final_ani", "contained"))
    best = Window.partitionBy("sample", "h").orderBy(F.desc("final_ani"), "genome")
    held = rows.filter("h is not null").join(first.select(*PAIR, "final_ani"), PAIR)
    mine = held.withColumn("own", F.first("genome").over(best) == F.col("genome")).filter("n_kmers is not null")
    counted = keep(mine.groupBy(*PAIR, "cnt", "own").agg(F.count(F.lit(1)).alias("n"), size))
    alone = pairs.filter("alone > 0").join(first.select(*PAIR), PAIR, "left_semi").select(*PAIR, "cnt", F.col("alone").alias("n"), "n_kmers")
    own = alone.unionByName(counted.filter("own").drop("own"))
    own = own.groupBy(*PAIR, "cnt").agg(F.sum("n").alias("n"), size)
    lost = counted.filter("not own").groupBy(*PAIR).agg(F.sum("n").alias("kmers_lost"))
    second = identities(coverage(own, None, k), k, estimator, min_ani).join(lost, PAIR, "left").fillna(0, ["kmers_lost"])
    before = first.select(*PAIR, F.col("contained").alias("contained_before"))
    kept = second.join(before, PAIR).filter(F.col("contained_before") - F.col("contained") < F.lit((redundant / 100) ** k) * F.col("n_kmers"))
    return shares(kept.join(sizes_bp, "genome"))


def shares(rows: DataFrame) -> DataFrame:
    """taxonomic_abundance and sequence_abundance in percent of the sample."""
    of = Window.partitionBy("sample")
    bases = F.col("final_cov") * F.col("gn_size")
    return rows.withColumns({"taxonomic_abundance": F.col("final_cov") / F.sum("final_cov").over(of) * 100, "sequence_abundance": bases / F.sum(bases).over(of) * 100})


def walk(counts: list[int], m: int) -> tuple[int, int]:
    """The moving median after counts, from m, and the sum of its values on the way."""
    total = 0
    for c in counts:
        m += 1 if c > m else -1
        total += m
    return m, total


def meeting(counts: list[int], low: int, high: int) -> tuple[int, int, int, int]:
    """(t, out, rest, met): walks from low and high, and so from all medians of the same
    parity between them, are one from step t on; where that ends, and its sum after
    step t. If they don't meet (met is 0), t is the number of counts.

    Two medians of the same parity never pass each other: they differ by two at
    least, and the lower one is at most one up while the upper one is one down.
    """
    t = 0
    while low != high and t < len(counts):
        c = counts[t]
        low += 1 if c > low else -1
        high += 1 if c > high else -1
        t += 1
    out, rest = walk(counts[t:], low)
    return t, out, rest, int(low == high)


def moving_medians(sample_kmers: DataFrame, block: int = MEDIAN_BLOCK) -> DataFrame:
    """(sample, depth_sum): a moving median over the counts above one in the order
    of hashes, one up where the count is larger and one down elsewhere, summed.

    A sample's hashes are cut into blocks of about ``block``. What a block makes of
    a median is soon the same for all medians of a parity that can come in, as walks
    that meet stay together; a block hands on where they meet, what follows, and the
    counts before. Then the blocks' few first counts are walked one after another.
    No median exceeds v + (the number of counts above v), whatever v is.
    """
    rows = sample_kmers.filter("cnt > 1").select("sample", "h", F.col("cnt").cast("long").alias("cnt"))
    above = Window.partitionBy("sample").orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    histogram = rows.groupBy("sample", "cnt").agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("h"))
    most = histogram.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
    most = most.groupBy("sample").agg(F.min(F.col("cnt") + F.col("above")).alias("most"), F.sum("n").alias("n"), F.max("h").alias("last"))
    # Hashes are uniform, so equal parts of their range hold about as many.
    part = F.floor(F.col("h") / (F.col("last") + 1.0) * F.ceil(F.col("n") / block)).cast("long")
    dealt = rows.join(most.withColumnRenamed("sample", "of_"), F.col("sample").eqNullSafe(F.col("of_"))).select("sample", part.alias("block"), "h", "cnt", "most")
    sample = rows.schema.fields[0]
    blocks = T.StructType([sample, T.StructField("block", T.LongType()), *(T.StructField(f"{c}{p}", T.LongType()) for p in (0, 1) for c in ("t", "out", "rest", "met")), T.StructField("first", T.ArrayType(T.LongType()))])
    schema = T.StructType([sample, T.StructField("depth_sum", T.LongType())])

    def groups(batches: Iterator, columns: int) -> Iterator[tuple]:
        """(key, rows) of consecutive rows with the same first columns."""
        import itertools

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        yield from itertools.groupby(rows, key=lambda r: r[:columns])

    def arrow(rows: Iterator[tuple], fields: T.StructType) -> Iterator:
        import itertools

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        while some := list(itertools.islice(rows, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), target)], schema=target)

    def meet(batches: Iterator) -> Iterator:
        from kelpwood.operators.contain import meeting

        def made() -> Iterator[tuple]:
            for (key, place), group in groups(batches, 2):
                counts, most = [], 0
                for r in group:
                    counts.append(r[3])
                    most = r[4]
                ends = [meeting(counts, p, max(p, most - (most - p) % 2)) for p in (0, 1)]
                yield key, place, *ends[0], *ends[1], counts[: max(e[0] for e in ends)]

        yield from arrow(made(), blocks)

    def compose(batches: Iterator) -> Iterator:
        from kelpwood.operators.contain import walk

        def made() -> Iterator[tuple]:
            for (key,), group in groups(batches, 1):
                m = total = 0
                for r in group:
                    t, out, rest, met = r[2:6] if m % 2 == 0 else r[6:10]
                    m, here = walk(r[10][:t], m)
                    total += here + rest
                    m = out if met else m
                yield key, total

        yield from arrow(made(), schema)

    found = map_arrow(dealt.repartition("sample", "block").sortWithinPartitions("sample", "block", "h"), meet, blocks)
    return map_arrow(found.repartition("sample").sortWithinPartitions("sample", "block"), compose, schema)


def read_counts(rows: DataFrame, identity: DataFrame, explained: DataFrame, cov: str = "true_cov") -> DataFrame:
    """rows with reads: how many of the sample's reads a genome stands for, by its
    coverage and size, the mean length of a read and the share of bases explained."""
    lengths = identity.select("sample", F.col("mean_read_length").alias("length_"))
    joined = rows.join(lengths, "sample").join(explained, "sample")
    return joined.withColumn("reads", F.round(F.col(cov) * F.col("gn_size") / F.col("length_") * F.col("explained")).cast("long")).drop("length_", "explained")


def read_identity(sample_kmers: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """(sample, kmer_identity): the share of counts on k-mers that occur not just
    once; of short reads at low depth 0.995^k instead. Depth is a moving median
    over the k-mers in the order of their hashes."""
    sums = sample_kmers.groupBy("sample").agg(
        F.count_if(F.col("cnt") == 1).alias("ones"), F.sum(F.when(F.col("cnt") != 1, F.col("cnt")).otherwise(0)).alias("more"), F.count_if(F.col("cnt") > 1).alias("several"),
    ).join(lengths, "sample").join(moving_medians(sample_kmers), "sample", "left")
    depth = F.coalesce("depth_sum", F.lit(0)) / (F.col("several") + 1)
    share = F.col("more") / (F.col("more") + F.col("ones") + 0.1)
    low = (depth < MEDIAN_FOR_IDENTITY) & (F.col("mean_read_length") < 400)
    return sums.select("sample", F.when(low, F.lit(0.995**k)).otherwise(F.least(share, F.lit(1.0))).alias("kmer_identity"), "mean_read_length", (F.col("ones") + F.col("more")).alias("total_count"))


def true_coverage(rows: DataFrame, identity: DataFrame, k: int) -> DataFrame:
    """rows with true_cov: coverage of the bases, not of the k-mers read without error."""
    length = F.col("mean_read_length")
    return rows.join(identity, "sample").withColumn("true_cov", F.col("final_cov") / F.col("kmer_identity") * (length / (length - k + 1)))


def explained_bases(rows: DataFrame, identity: DataFrame, k: int, c: int, cov: str = "final_cov") -> DataFrame:
    """(sample, explained): the share of a sample's bases that its results cover, 1 at most."""
    covered = rows.groupBy("sample").agg(F.sum(F.col("gn_size") * F.col(cov)).alias("covered"))
    length = F.col("mean_read_length")
    bases = F.lit(c) * F.col("total_count") * (length / (length - k + 1))
    joined = identity.join(covered, "sample", "left").fillna(0.0, ["covered"])
    return joined.select("sample", F.when(bases == 0, F.lit(0.0)).otherwise(F.least(F.col("covered") / bases, F.lit(1.0))).alias("explained"))
