"""Community ecology on long tables (sample, taxon, value): only what is above
zero is stored, and zeros enter through closed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stores import stored

#: Distances between samples are of all pairs, and so are correlations of taxa: of at most so many.
MOST_SAMPLES, MOST_TAXA = 5_000, 50_000


def alpha_diversity(rows: DataFrame) -> DataFrame:
    """(sample, richness, shannon, effective): Shannon entropy in nats over shares, and its exponential."""
    share = F.col("value") / F.sum("value").over(Window.partitionBy("sample"))
    present = rows.filter("value > 0").withColumn("p", share)
    sums = present.groupBy("sample").agg(F.count(F.lit(1)).alias("richness"), (-F.sum(F.col("p") * F.log("p"))).alias("shannon"))
    return sums.withColumn("effective", F.exp("shannon"))


def diversity_rank(alpha: DataFrame) -> DataFrame:
    """place: one more than the number of samples with a larger effective number."""
    ranked = global_rank(alpha, F.desc("effective"), name="at")
    return alpha.join(ranked.groupBy("effective").agg(F.min("at").alias("place")), "effective")


def global_rank(rows: DataFrame, *order: Column | str, name: str) -> DataFrame:
    """rows with their place in the order, from 1: ranges of the order are ranked
    each by themselves, and the ranges before them counted."""
    dealt = rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id())
    dealt = stored(dealt)
    counts = dealt.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"))
    # One row for each range, so a single task adds them up.
    before = F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    placed = dealt.withColumn("inner_", inner).join(counts.select("range_", before.alias("before_")), "range_")
    return placed.withColumn(name, F.col("inner_") + F.col("before_")).drop("range_", "inner_", "before_")


def _pairs_of(names: DataFrame, most: int, what: str) -> DataFrame:
    """(a, b) of all names a < b, of ``most`` names at most: a result of all pairs is
    as large as their number's square, so the bound is on the names."""
    n = names.count()
    if n > most:
        raise ValueError(f"{n} {what}; all pairs of at most {most} are made")
    return names.toDF("a").join(F.broadcast(names.toDF("b")), F.col("a") < F.col("b"))


def sample_pairs(rows: DataFrame) -> DataFrame:
    """(s1, s2, least, product) for all samples s1 < s2: sums of the smaller values
    and of products over shared taxa, zero for samples that share none."""
    a = rows.select("taxon", F.col("sample").alias("s1"), F.col("value").alias("x"))
    b = rows.select("taxon", F.col("sample").alias("s2"), F.col("value").alias("y"))
    met = a.join(b, "taxon").filter("s1 < s2").groupBy("s1", "s2").agg(F.sum(F.least("x", "y")).alias("least"), F.sum(F.col("x") * F.col("y")).alias("product"))
    every = _pairs_of(rows.select("sample").distinct(), MOST_SAMPLES, "samples").toDF("s1", "s2")
    return every.join(met, ["s1", "s2"], "left").fillna(0.0, ["least", "product"])


def _with_sums(pairs: DataFrame, rows: DataFrame, value: Column) -> DataFrame:
    sums = rows.groupBy("sample").agg(F.sum(value).alias("t"))
    for s in ("1", "2"):
        pairs = pairs.join(sums.select(F.col("sample").alias(f"s{s}"), F.col("t").alias(f"t{s}")), f"s{s}")
    return pairs


def bray_curtis(rows: DataFrame) -> DataFrame:
    """(s1, s2, d) of all pairs; samples that share nothing are at 1, two without anything at 0."""
    pairs = _with_sums(sample_pairs(rows), rows, F.col("value"))
    total = F.col("t1") + F.col("t2")
    return pairs.select("s1", "s2", F.when(total == 0, F.lit(0.0)).otherwise(1 - 2 * F.col("least") / total).alias("d"))


def euclidean(rows: DataFrame) -> DataFrame:
    """(s1, s2, d) of all pairs, by |x|^2 + |y|^2 - 2xy."""
    pairs = _with_sums(sample_pairs(rows), rows, F.col("value") * F.col("value"))
    return pairs.select("s1", "s2", F.sqrt(F.greatest(F.lit(0.0), F.col("t1") + F.col("t2") - 2 * F.col("product"))).alias("d"))


def taxon_correlation(rows: DataFrame, n_samples: int) -> DataFrame:
    """(t1, t2, d) of all pairs of taxa, MOST_TAXA at most: 1 - r over all n_samples,
    absent values being zero; 1 where one doesn't vary."""
    sums = rows.groupBy("taxon").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    a = rows.select("sample", F.col("taxon").alias("t1"), F.col("value").alias("x"))
    b = rows.select("sample", F.col("taxon").alias("t2"), F.col("value").alias("y"))
    met = a.join(b, "sample").filter("t1 < t2").groupBy("t1", "t2").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    pairs = _pairs_of(sums.select("taxon"), MOST_TAXA, "taxa").toDF("t1", "t2").join(met, ["t1", "t2"], "left").fillna(0.0, ["xy"])
    for t in ("1", "2"):
        pairs = pairs.join(sums.select(F.col("taxon").alias(f"t{t}"), F.col("s").alias(f"s{t}"), F.col("q").alias(f"q{t}")), f"t{t}")
    n = float(n_samples)
    v1, v2 = F.col("q1") - F.col("s1") * F.col("s1") / n, F.col("q2") - F.col("s2") * F.col("s2") / n
    flat = (v1 <= 1e-12) | (v2 <= 1e-12)
    r = (F.col("xy") - F.col("s1") * F.col("s2") / n) / F.sqrt(v1 * v2)
    return pairs.select("t1", "t2", F.when(flat, F.lit(1.0)).otherwise(1 - r).alias("d"))


def mirrored(distances: DataFrame) -> DataFrame:
    """Each pair in both directions."""
    return distances.unionByName(distances.select(F.col("s2").alias("s1"), F.col("s1").alias("s2"), "d"))


def nearest(distances: DataFrame, k: int = 4) -> DataFrame:
    """(sample, neighbour, d, place) of each sample's k nearest others."""
    place = F.row_number().over(Window.partitionBy("s1").orderBy("d", "s2"))
    return mirrored(distances).withColumn("place", place).filter(F.col("place") <= k).select(F.col("s1").alias("sample"), F.col("s2").alias("neighbour"), "d", "place")


def gower_center(distances: DataFrame) -> DataFrame:
    """(s1, s2, b): -d^2 / 2 less the means of its row and its column, plus the mean
    of all; the diagonal counts in the means and is left out of the result."""
    half = mirrored(distances).withColumn("a", -F.col("d") * F.col("d") / 2)
    n = half.select("s1").distinct().count()
    rows = half.groupBy("s1").agg((F.sum("a") / n).alias("m"))
    grand = rows.agg(F.avg("m")).first()[0] or 0.0
    other = rows.select(F.col("s1").alias("s2"), F.col("m").alias("m2"))
    return half.join(rows, "s1").join(other, "s2").select("s1", "s2", (F.col("a") - F.col("m") - F.col("m2") + grand).alias("b"))


def silhouettes(distances: DataFrame, clusters: DataFrame) -> DataFrame:
    """(sample, cluster, s) from pair distances and (sample, cluster): own mean
    distance against the nearest other cluster's; 0 alone in a cluster."""
    both = mirrored(distances).join(clusters.select(F.col("sample").alias("s1"), F.col("cluster").alias("c1")), "s1").join(clusters.select(F.col("sample").alias("s2"), F.col("cluster").alias("c2")), "s2")
    means = both.groupBy("s1", "c1", "c2").agg(F.avg("d").alias("m"))
    sides = means.groupBy("s1", "c1").agg(F.max(F.when(F.col("c1") == F.col("c2"), F.col("m"))).alias("a"), F.min(F.when(F.col("c1") != F.col("c2"), F.col("m"))).alias("b"))
    top = F.greatest("a", "b")
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / top)
    return clusters.join(sides.select(F.col("s1").alias("sample"), s.alias("s")), "sample", "left").fillna(0.0, ["s"])


# ---- on the table of samples by samples, which is collected


def square(distances: DataFrame):
    """(names, matrix) of all pairs' distances, of MOST_SAMPLES samples at most: 12.5 million pairs."""
    import numpy as np

    got = distances.limit(MOST_SAMPLES * (MOST_SAMPLES - 1) // 2 + 1).toArrow()
    one, two, values = (got.column(c).to_numpy() for c in ("s1", "s2", "d"))
    names = np.unique(np.concatenate([one, two]).astype(str)) if len(one) else np.array([], str)
    if len(names) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    d = np.zeros((len(names), len(names)))
    if len(one):
        a, b = np.searchsorted(names, one.astype(str)), np.searchsorted(names, two.astype(str))
        d[a, b] = d[b, a] = values
    return names.tolist(), d


def principal_coordinates(d, dims: int = 2):
    """(points, share of the positive eigenvalues each axis explains); the first
    point that isn't zero on an axis is positive."""
    import numpy as np

    n = len(d)
    center = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(center @ (-(d**2) / 2) @ center)
    order = np.argsort(-values)[:dims]
    points = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    for j in range(points.shape[1]):
        far = np.flatnonzero(np.abs(points[:, j]) > 1e-9)
        if len(far) and points[far[0], j] < 0:
            points[:, j] *= -1
    total = values[values > 0].sum()
    return points, np.maximum(values[order], 0) / (total if total > 0 else 1)


def k_means(points, k: int, rounds: int = 60):
    """Labels: seeds are the point farthest from the mean, then always the one
    farthest from all seeds; an empty cluster keeps its centre."""
    import numpy as np

    first = int(np.argmax(((points - points.mean(0)) ** 2).sum(1)))
    centres = [points[first]]
    while len(centres) < k:
        gap = np.min([((points - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(points[int(np.argmax(gap))])
    centres, labels = np.array(centres), None
    for _ in range(rounds):
        new = np.argmin(((points[:, None] - centres[None]) ** 2).sum(2), axis=1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        for c in range(k):
            if (labels == c).any():
                centres[c] = points[labels == c].mean(0)
    return labels


def mean_silhouette(points, labels) -> float:
    import numpy as np

    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    scores = np.zeros(len(points))
    for i in range(len(points)):
        own = (labels == labels[i]) & (np.arange(len(points)) != i)
        if own.any() and len(set(labels.tolist())) > 1:
            a = d[i, own].mean()
            b = min(d[i, labels == c].mean() for c in set(labels.tolist()) if c != labels[i])
            scores[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0
    return float(scores.mean())


def auto_k(points, most: int = 8):
    """(k, labels, silhouette) for the k from 2 with the best mean silhouette, the
    smallest of equals; fewer than three points are one cluster, with silhouette 0."""
    import numpy as np

    if len(points) < 3:
        return 1, np.zeros(len(points), np.int64), 0.0
    best = None
    for k in range(2, min(most, len(points) - 1) + 1):
        labels = k_means(points, k)
        score = mean_silhouette(points, labels)
        if best is None or score > best[2] + 1e-12:
            best = (k, labels, score)
    return best


def linkage_order(d) -> list[int]:
    """Leaves by average linkage: the closest two groups are joined, first the one
    with the smaller first leaf; fewer than three stay as they are."""
    import numpy as np

    n = len(d)
    if n < 3:
        return list(range(n))
    dist = d.astype(float).copy()
    np.fill_diagonal(dist, np.inf)
    groups, sizes = {i: [i] for i in range(n)}, np.ones(n)
    for _ in range(n - 1):
        i, j = divmod(int(np.argmin(dist)), n)
        i, j = min(i, j), max(i, j)
        merged = (sizes[i] * dist[i] + sizes[j] * dist[j]) / (sizes[i] + sizes[j])
        dist[i], dist[:, i] = merged, merged
        dist[i, i] = np.inf
        dist[j], dist[:, j] = np.inf, np.inf
        sizes[i] += sizes[j]
        groups[i] += groups.pop(j)
    return groups[0] if 0 in groups else next(iter(groups.values()))


def ordination(spark: SparkSession, distances: DataFrame) -> DataFrame:
    """(sample, x, y, explained_x, explained_y)."""
    names, d = square(distances)
    if not names:
        return spark.createDataFrame([], "sample string, x double, y double, explained_x double, explained_y double")
    points, explained = principal_coordinates(d)
    rows = [(s, float(p[0]), float(p[1]) if len(p) > 1 else 0.0, float(explained[0]), float(explained[1]) if len(explained) > 1 else 0.0) for s, p in zip(names, points)]
    return spark.createDataFrame(rows, "sample string, x double, y double, explained_x double, explained_y double")


def marker_split(rows: DataFrame, poles: dict[str, list[str]], least_markers: float = 5.0, least_gap: float = 8.3) -> DataFrame:
    """Per sample: sums of the poles' marker taxa, the leading pole, the gap of its
    share to the next in points, and the call: the leading pole, "between" if
    the gap is small, "" if there are too few markers."""
    pole = F.lit(None).cast("string")
    for key, taxa in poles.items():
        pole = F.when(F.col("taxon").isin(taxa), F.lit(key)).otherwise(pole)
    keys = list(poles)
    marked = rows.withColumn("pole", pole)
    sums = marked.groupBy("sample").agg(*[F.sum(F.when(F.col("pole") == k, F.col("value")).otherwise(0.0)).alias(f"sum_{k}") for k in keys])
    markers = sum((F.col(f"sum_{k}") for k in keys[1:]), F.col(f"sum_{keys[0]}"))
    sums = sums.withColumn("markers", markers)
    share = lambda k: F.when(F.col("markers") > 0, F.col(f"sum_{k}") / F.col("markers") * 100).otherwise(0.0)
    order = F.reverse(F.array_sort(F.array(*[F.struct(share(k).alias("v"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(keys)])))
    sums = sums.withColumn("order", order)
    gap = F.col("order")[0]["v"] - F.col("order")[1]["v"]
    lead = F.col("order")[0]["k"]
    call = F.when(F.col("markers") < least_markers, "").when(gap >= least_gap, lead).otherwise("between")
    return sums.select("sample", *[f"sum_{k}" for k in keys], "markers", lead.alias("lead"), gap.alias("gap"), call.alias("call"))


def compare_profiles(ref: DataFrame, other: DataFrame, top: int = 25) -> DataFrame:
    """One row on two profiles (taxon, value): shared, lost and gained taxa, Kendall's
    tau over the top of ref, Spearman's (ties in the order of names) and Pearson's
    (log10) correlation, and the median, 5th and 95th percentile of the ratio."""
    a = ref.select("taxon", F.col("value").alias("x"))
    b = other.select("taxon", F.col("value").alias("y"))
    both = a.join(b, "taxon", "full_outer")
    counts = both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), F.count_if(F.col("y").isNull()).alias("lost"), F.count_if(F.col("x").isNull()).alias("gained"))
    shared = both.filter("x is not null and y is not null").withColumn("ratio", F.col("y") / F.col("x"))
    ranked = shared
    for c in ("x", "y"):
        ranked = global_rank(ranked, c, "taxon", name=f"r{c}")
    ranked = stored(global_rank(ranked, "ratio", "taxon", name="at"))
    stats = ranked.agg(F.corr("rx", "ry").alias("spearman"), F.corr(F.log10("x"), F.log10("y")).alias("pearson"), F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    at = {"ratio_median": F.floor(n / 2), "ratio_low": F.floor(n / 20), "ratio_high": F.least(n - 1, F.floor(n * 19 / 20))}
    # Three places of the order, next to the one row of figures.
    picked = ranked.select("at", "ratio").join(F.broadcast(stats), F.col("at").isin(*[p + 1 for p in at.values()]))
    stats = stats.join(picked.agg(*[F.max(F.when(F.col("at") == p + 1, F.col("ratio"))).alias(c) for c, p in at.items()])).drop("n")
    head = a.orderBy(F.desc("x"), "taxon").limit(top).join(ranked.select("taxon", "rx", "ry"), "taxon")
    left, right = head.select(F.col("rx").alias("a1"), F.col("ry").alias("b1")), head.select(F.col("rx").alias("a2"), F.col("ry").alias("b2"))
    tau = left.join(F.broadcast(right), F.col("a1") < F.col("a2")).agg(F.count_if(F.col("b1") > F.col("b2")).alias("inv"), F.count(F.lit(1)).alias("pairs"))
    tau = tau.select((1 - 2 * F.col("inv") / F.nullif("pairs", F.lit(0))).alias("tau"))
    return counts.join(stats).join(tau)


def identity_deltas(ref: DataFrame, other: DataFrame) -> DataFrame:
    """One row on the identities (taxon, ani) of taxa that two profiles share:
    the upper median, least and largest difference of other's to ref's."""
    both = ref.select("taxon", F.col("ani").alias("a")).join(other.select("taxon", F.col("ani").alias("b")), "taxon")
    ranked = stored(global_rank(both.select("taxon", (F.col("b") - F.col("a")).alias("delta")), "delta", "taxon", name="at"))
    ends = ranked.agg(F.count(F.lit(1)).alias("n"), F.min("delta").alias("least"), F.max("delta").alias("most"))
    middle = ranked.join(F.broadcast(ends.select("n")), F.col("at") == F.floor(F.col("n") / 2) + 1).agg(F.max("delta").alias("median"))
    return ends.join(middle).select("n", "median", "least", "most")


def split_refusal(refs: Column, key: Column, genomes: Column, placed: Column, wanted_key: str, wanted_genomes: int) -> Column:
    """Why marker_split must not be shown for a view, or "": it holds samples of
    several references or of an unknown one, or of another catalogue or release
    than the markers are made for, or there is no taxonomy."""
    return (
        F.when(refs > 1, "mixed references").when(refs == 0, "unknown reference").when(key != wanted_key, "other catalogue")
        .when(genomes != wanted_genomes, "other release").when(~placed, "no taxonomy").otherwise("")
    )
