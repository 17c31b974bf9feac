"""Queries on abundance tables: roll-ups, exports, ecology and screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ecology as ec
from ..operators import matrix as mx
from ..operators import screening as sc
from ..sources.stores import scratch, stored
from . import inputs as I

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


AB = """
ab AS (SELECT sample, genome, value / sum(value) OVER (PARTITION BY sample) * 100 AS value FROM (
  SELECT n_name AS sample, l_partkey AS genome, sum(l_quantity) AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL))"""
TAX = "tax AS (SELECT p_partkey AS genome, p_type AS type, p_type || '|' || p_brand AS brand, p_type || '|' || p_brand || '|' || p_name AS species, p_name AS name FROM part)"
BR = f"{AB}, {TAX}, br AS (SELECT sample, brand AS taxon, sum(value) AS value FROM ab JOIN tax USING (genome) GROUP BY ALL)"
PAIRS = """sums AS (SELECT sample, sum(value) AS t, sum(value * value) AS q FROM br GROUP BY sample),
met AS (SELECT a.sample AS s1, b.sample AS s2, sum(least(a.value, b.value)) AS least, sum(a.value * b.value) AS product FROM br a JOIN br b ON a.taxon = b.taxon AND a.sample < b.sample GROUP BY ALL),
pairs AS (SELECT a.sample AS s1, b.sample AS s2, coalesce(least, 0) AS least, coalesce(product, 0) AS product FROM sums a JOIN sums b ON a.sample < b.sample LEFT JOIN met ON met.s1 = a.sample AND met.s2 = b.sample)"""
BRAY = f"{BR}, {PAIRS}, dist AS (SELECT s1, s2, CASE WHEN a.t + b.t = 0 THEN 0 ELSE 1 - 2 * least / (a.t + b.t) END AS d FROM pairs JOIN sums a ON a.sample = s1 JOIN sums b ON b.sample = s2)"
MIRROR = "mir AS (SELECT s1, s2, d FROM dist UNION ALL SELECT s2, s1, d FROM dist)"


def _taxon_rows(spark, d, rank="brand"):
    return mx.roll_up(I.abundance(spark, d), I.taxonomy(spark, d), rank)


def _r(c, n=6):
    return F.round(c, n).alias(c)


@query("relative_abundance", f"WITH {AB} SELECT sample, genome, round(value, 9) AS value FROM ab")
def relative_abundance(spark: SparkSession, d: str) -> DataFrame:
    return I.abundance(spark, d).select("sample", "genome", _r("value", 9))


@query("matrix_rank", f"WITH {AB}, {TAX} SELECT sample, coalesce(type, 'unclassified at type level') AS taxon, round(sum(value), 6) AS value, count(DISTINCT genome) AS genomes FROM ab LEFT JOIN tax USING (genome) GROUP BY ALL")
def matrix_rank(spark: SparkSession, d: str) -> DataFrame:
    return _taxon_rows(spark, d, "type").select("sample", "taxon", _r("value"), "genomes")


NATIONS = [f"NATION_{i}" for i in range(25)]
_PIVOT = ", ".join(f"round(coalesce(sum(value) FILTER (WHERE sample = '{n}'), 0), 6) AS \"{n}\"" for n in NATIONS)


@query("matrix_pivot", f"WITH {BR} SELECT taxon, {_PIVOT}, round(max(value), 6) AS max_abundance FROM br GROUP BY taxon")
def matrix_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = mx.pivot(_taxon_rows(spark, d), NATIONS)
    return wide.select("taxon", *[_r(n) for n in [*NATIONS, "max_abundance"]])


@query("species_label", f"WITH {TAX}, s AS (SELECT name, count(*) > 1 AS shared FROM tax GROUP BY name) SELECT genome, CASE WHEN tax.name IS NULL THEN '(' || genome || ')' WHEN shared THEN tax.name || ' [' || genome || ']' ELSE tax.name END AS label FROM tax LEFT JOIN s ON s.name = tax.name")
def species_label(spark: SparkSession, d: str) -> DataFrame:
    return mx.species_labels(I.taxonomy(spark, d).select("genome", "name"))


@query("metaphlan_rollup", f"""WITH {AB}, p AS (SELECT sample, value, 'd__' || replace(p_type, ' ', '_') AS a, 'g__' || replace(p_brand, ' ', '_') AS b, 's__' || replace(p_name, ' ', '_') AS c FROM ab JOIN part ON p_partkey = genome)
SELECT CASE WHEN c IS NOT NULL THEN a || '|' || b || '|' || c WHEN b IS NOT NULL THEN a || '|' || b ELSE a END AS clade, CASE WHEN c IS NOT NULL THEN 3 WHEN b IS NOT NULL THEN 2 ELSE 1 END AS depth, sample, round(sum(value), 5) AS value
FROM p GROUP BY sample, GROUPING SETS ((a), (a, b), (a, b, c))""")
def metaphlan_rollup(spark: SparkSession, d: str) -> DataFrame:
    parts = I.table(spark, d, "part").withColumnRenamed("p_partkey", "genome")
    return mx.clade_table(I.abundance(spark, d), parts, {"p_type": "d", "p_brand": "g", "p_name": "s"}).select("clade", "depth", "sample", _r("value", 5))


_BIOM = ", ".join(f"round(coalesce(sum(value) FILTER (WHERE sample = '{n}'), 0), 6)" for n in NATIONS)


@query("biom_rows", f"WITH {BR} SELECT taxon, [{_BIOM}] AS data FROM br GROUP BY taxon")
def biom_rows(spark: SparkSession, d: str) -> DataFrame:
    return mx.biom_rows(_taxon_rows(spark, d), NATIONS)


@query("engine_concat", f"WITH {AB} SELECT lower(sample) || '.fq.gz' AS sample_file, genome, round(value, 9) AS value FROM ab")
def engine_concat(spark: SparkSession, d: str) -> DataFrame:
    return mx.labelled_concat(I.abundance(spark, d), F.concat(F.lower("sample"), F.lit(".fq.gz"))).select("sample_file", "genome", _r("value", 9))


@query("alpha_diversity", f"WITH {AB}, p AS (SELECT sample, value / sum(value) OVER (PARTITION BY sample) AS p FROM ab WHERE value > 0) SELECT sample, count(*) AS richness, round(-sum(p * ln(p)), 6) AS shannon, round(exp(-sum(p * ln(p))), 4) AS effective FROM p GROUP BY sample")
def alpha_diversity(spark: SparkSession, d: str) -> DataFrame:
    return ec.alpha_diversity(I.abundance(spark, d)).select("sample", "richness", _r("shannon"), _r("effective", 4))


@query("diversity_rank", f"WITH {AB}, p AS (SELECT sample, value / sum(value) OVER (PARTITION BY sample) AS p FROM ab WHERE value > 0), e AS (SELECT sample, round(exp(-sum(p * ln(p))), 4) AS effective FROM p GROUP BY sample) SELECT sample, effective, rank() OVER (ORDER BY effective DESC) AS place FROM e")
def diversity_rank(spark: SparkSession, d: str) -> DataFrame:
    return ec.diversity_rank(ec.alpha_diversity(I.abundance(spark, d)).select("sample", _r("effective", 4))).select("sample", "effective", "place")


@query("bray_curtis", f"WITH {BRAY} SELECT s1, s2, round(d, 6) AS d FROM dist")
def bray_curtis(spark: SparkSession, d: str) -> DataFrame:
    return ec.bray_curtis(_taxon_rows(spark, d)).select("s1", "s2", _r("d"))


@query("euclidean", f"WITH {BR}, {PAIRS} SELECT s1, s2, round(sqrt(greatest(0, a.q + b.q - 2 * product)), 6) AS d FROM pairs JOIN sums a ON a.sample = s1 JOIN sums b ON b.sample = s2")
def euclidean(spark: SparkSession, d: str) -> DataFrame:
    return ec.euclidean(_taxon_rows(spark, d)).select("s1", "s2", _r("d"))


@query("taxon_correlation", f"""WITH {BR}, n AS (SELECT count(DISTINCT sample) AS n FROM ab), g AS (SELECT taxon, sum(value) AS s, sum(value * value) AS q FROM br GROUP BY taxon),
x AS (SELECT a.taxon AS t1, b.taxon AS t2, sum(a.value * b.value) AS xy FROM br a JOIN br b ON a.sample = b.sample AND a.taxon < b.taxon GROUP BY ALL),
v AS (SELECT a.taxon AS t1, b.taxon AS t2, coalesce(xy, 0) - a.s * b.s / n AS c, a.q - a.s * a.s / n AS v1, b.q - b.s * b.s / n AS v2 FROM g a JOIN g b ON a.taxon < b.taxon LEFT JOIN x ON x.t1 = a.taxon AND x.t2 = b.taxon, n)
SELECT t1, t2, round(CASE WHEN v1 <= 1e-12 OR v2 <= 1e-12 THEN 1 ELSE 1 - c / sqrt(v1 * v2) END, 6) AS d FROM v""")
def taxon_correlation(spark: SparkSession, d: str) -> DataFrame:
    n = I.abundance(spark, d).select("sample").distinct().count()
    return ec.taxon_correlation(_taxon_rows(spark, d), n).select("t1", "t2", _r("d"))


@query("nearest_samples", f"WITH {BRAY}, r AS (SELECT s1, s2, round(d, 6) AS d FROM dist), mir AS (SELECT s1, s2, d FROM r UNION ALL SELECT s2, s1, d FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY d, s2) AS place FROM mir) SELECT s1 AS sample, s2 AS neighbour, d, place FROM o WHERE place <= 4")
def nearest_samples(spark: SparkSession, d: str) -> DataFrame:
    return ec.nearest(ec.bray_curtis(_taxon_rows(spark, d)).select("s1", "s2", _r("d")))


def _top_sql(source: str, n: int, per_sample: bool) -> str:
    if per_sample:
        named = f"named AS (SELECT sample, CASE WHEN place <= {n} THEN taxon ELSE 'other' END AS taxon, value FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value DESC, taxon) AS place FROM {source}))"
    else:
        named = f"tops AS (SELECT taxon FROM (SELECT taxon, sum(value) AS t FROM {source} GROUP BY taxon) ORDER BY t DESC, taxon LIMIT {n}), named AS (SELECT sample, coalesce(t.taxon, 'other') AS taxon, value FROM {source} s LEFT JOIN tops t USING (taxon))"
    return f"{named}, g AS (SELECT sample, taxon, sum(value) AS value FROM named GROUP BY ALL) SELECT sample, taxon, round(value / sum(value) OVER (PARTITION BY sample) * 100, 6) AS share FROM g"


# Values rounded before ranking, so that sums in another order rank alike.
_BR6 = f"{BR}, b6 AS (SELECT sample, taxon, round(value, 6) AS value FROM br)"


def _rounded(spark, d):
    return _taxon_rows(spark, d).select("sample", "taxon", _r("value"))


@query("composition_topn", f"WITH {_BR6}, {_top_sql('b6', 10, False)}")
def composition_topn(spark: SparkSession, d: str) -> DataFrame:
    return mx.top_and_other(_rounded(spark, d), 10, per_sample=False).select("sample", "taxon", _r("share"))


@query("sample_topn", f"WITH {_BR6}, {_top_sql('b6', 9, True)}")
def sample_topn(spark: SparkSession, d: str) -> DataFrame:
    return mx.top_and_other(_rounded(spark, d), 9, per_sample=True).select("sample", "taxon", _r("share"))


@query("gower_center", f"""WITH {BRAY}, {MIRROR}, n AS (SELECT count(DISTINCT s1) AS n FROM mir), a AS (SELECT s1, s2, -d * d / 2 AS a FROM mir), m AS (SELECT s1, sum(a) / any_value(n) AS m FROM a, n GROUP BY s1), g AS (SELECT avg(m) AS g FROM m)
SELECT a.s1, a.s2, round(a.a - m1.m - m2.m + g, 8) AS b FROM a JOIN m m1 ON m1.s1 = a.s1 JOIN m m2 ON m2.s1 = a.s2, g""")
def gower_center(spark: SparkSession, d: str) -> DataFrame:
    return ec.gower_center(ec.bray_curtis(_taxon_rows(spark, d))).select("s1", "s2", _r("b", 8))


def _regions(spark, d):
    return I.table(spark, d, "nation").select(F.col("n_name").alias("sample"), F.col("n_regionkey").alias("cluster"))


@query("silhouette", f"""WITH {BRAY}, {MIRROR}, c AS (SELECT n_name AS sample, n_regionkey AS cluster FROM nation),
m AS (SELECT s1, a.cluster AS c1, b.cluster AS c2, avg(d) AS m FROM mir JOIN c a ON a.sample = s1 JOIN c b ON b.sample = s2 GROUP BY ALL),
s AS (SELECT s1, max(m) FILTER (WHERE c1 = c2) AS a, min(m) FILTER (WHERE c1 <> c2) AS b FROM m GROUP BY s1)
SELECT sample, cluster, round(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM c LEFT JOIN s ON s1 = sample""")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    return ec.silhouettes(ec.bray_curtis(_taxon_rows(spark, d)), _regions(spark, d)).select("sample", "cluster", _r("s"))


def _points(spark, d):
    names, dist = ec.square(ec.bray_curtis(_taxon_rows(spark, d)))
    return names, ec.principal_coordinates(dist)[0], dist


@query("pcoa")
def pcoa(spark: SparkSession, d: str) -> DataFrame:
    return ec.ordination(spark, ec.bray_curtis(_taxon_rows(spark, d)))


@query("kmeans")
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    names, points, _ = _points(spark, d)
    return spark.createDataFrame([(s, int(c)) for s, c in zip(names, ec.k_means(points, 3))], "sample string, cluster int")


@query("auto_k")
def auto_k(spark: SparkSession, d: str) -> DataFrame:
    names, points, _ = _points(spark, d)
    k, labels, score = ec.auto_k(points)
    return spark.createDataFrame([(s, int(c), k, score) for s, c in zip(names, labels)], "sample string, cluster int, k int, silhouette double")


@query("cluster_order")
def cluster_order(spark: SparkSession, d: str) -> DataFrame:
    names, _, dist = _points(spark, d)
    return spark.createDataFrame([(place, names[i]) for place, i in enumerate(ec.linkage_order(dist))], "place int, sample string")


# Which taxa stand for the poles of the split.
POLES = {"B": ["ECONOMY", "SMALL"], "P": ["PROMO", "STANDARD"], "R": ["MEDIUM", "LARGE"]}
_POLE = "CASE " + " ".join(f"WHEN type IN ({', '.join(repr(t) for t in v)}) THEN '{k}'" for k, v in POLES.items()) + " END"


@query("marker_split", f"""WITH {AB}, {TAX}, s AS (SELECT sample, {', '.join(f"coalesce(sum(value) FILTER (WHERE {_POLE} = '{k}'), 0) AS {k}" for k in POLES)} FROM ab JOIN tax USING (genome) GROUP BY sample),
m AS (SELECT *, B + P + R AS markers FROM s),
l AS (SELECT sample, unnest(['B', 'P', 'R']) AS k, unnest([B, P, R]) / markers * 100 AS v, unnest([1, 2, 3]) AS i FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY v DESC, i) AS place FROM l),
g AS (SELECT sample, max(k) FILTER (WHERE place = 1) AS lead, max(v) FILTER (WHERE place = 1) - max(v) FILTER (WHERE place = 2) AS gap FROM o GROUP BY sample)
SELECT sample, round(B, 6) AS "sum_B", round(P, 6) AS "sum_P", round(R, 6) AS "sum_R", round(markers, 6) AS markers, lead, round(gap, 6) AS gap, CASE WHEN markers < 5 THEN '' WHEN gap >= 8.3 THEN lead ELSE 'between' END AS call FROM m JOIN g USING (sample)""")
def marker_split(spark: SparkSession, d: str) -> DataFrame:
    split = ec.marker_split(_taxon_rows(spark, d, "type"), POLES)
    return split.select("sample", *[_r(f"sum_{k}") for k in POLES], _r("markers"), "lead", _r("gap"), "call")


@query("split_refusal", """WITH v AS (SELECT n_name AS view, r_name AS key, count(DISTINCT s_acctbal < 0) AS refs, count(s_suppkey) AS genomes, coalesce(max(s_acctbal) > 5000, false) AS placed
FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT view, CASE WHEN refs > 1 THEN 'mixed references' WHEN refs = 0 THEN 'unknown reference' WHEN key <> 'ASIA' THEN 'other catalogue' WHEN genomes <> 4 THEN 'other release' WHEN NOT placed THEN 'no taxonomy' ELSE '' END AS refusal FROM v""")
def split_refusal(spark: SparkSession, d: str) -> DataFrame:
    """Nations as views whose references are suppliers in credit or in debt."""
    supplier = I.table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    nation = I.table(spark, d, "nation").join(I.table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    views = nation.join(supplier, "n_nationkey", "left").groupBy(F.col("n_name").alias("view"), F.col("r_name").alias("key")).agg(
        F.count_distinct(F.col("s_acctbal") < 0).alias("refs"), F.count("s_suppkey").alias("genomes"), F.coalesce(F.max("s_acctbal") > 5000, F.lit(False)).alias("placed"))
    return views.select("view", ec.split_refusal(F.col("refs"), F.col("key"), F.col("genomes"), F.col("placed"), "ASIA", 4).alias("refusal"))


# Two profiles of one table: items that came back, and the others.
_HALF = """q AS (SELECT l_returnflag = 'R' AS back, l_partkey AS taxon, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
ref AS (SELECT taxon, v / (SELECT sum(v) FROM q WHERE NOT back) * 100 AS x FROM q WHERE NOT back), red AS (SELECT taxon, v / (SELECT sum(v) FROM q WHERE back) * 100 AS y FROM q WHERE back)"""


def _halves(spark, d):
    line = I.table(spark, d, "lineitem").groupBy((F.col("l_returnflag") == "R").alias("back"), F.col("l_partkey").alias("taxon")).agg(F.sum("l_quantity").alias("value"))
    totals = F.broadcast(line.groupBy("back").agg(F.sum("value").alias("total")))  # two rows
    shares = line.join(totals, "back").select("back", "taxon", (F.col("value") / F.col("total") * 100).alias("value"))
    return shares.filter("not back").drop("back"), shares.filter("back").drop("back")


@query("profile_diff", f"WITH {_HALF} SELECT coalesce(ref.taxon, red.taxon) AS taxon, round(x, 9) AS ref, round(y, 9) AS other, CASE WHEN y IS NULL THEN 'lost' WHEN x IS NULL THEN 'gained' ELSE 'shared' END AS state FROM ref FULL JOIN red ON ref.taxon = red.taxon")
def profile_diff(spark: SparkSession, d: str) -> DataFrame:
    a, b = _halves(spark, d)
    both = a.withColumnRenamed("value", "ref").join(b.withColumnRenamed("value", "other"), "taxon", "full_outer")
    state = F.when(F.col("other").isNull(), "lost").when(F.col("ref").isNull(), "gained").otherwise("shared")
    return both.select("taxon", _r("ref", 9), _r("other", 9), state.alias("state"))


@query("profile_compare", f"""WITH {_HALF}, j AS (SELECT coalesce(ref.taxon, red.taxon) AS taxon, x, y FROM ref FULL JOIN red ON ref.taxon = red.taxon),
s AS (SELECT *, row_number() OVER (ORDER BY x, taxon) AS rx, row_number() OVER (ORDER BY y, taxon) AS ry FROM j WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT list(y / x ORDER BY y / x) AS r, corr(rx, ry) AS spearman, corr(log10(x), log10(y)) AS pearson FROM s),
h AS (SELECT s.* FROM s JOIN (SELECT taxon FROM ref ORDER BY x DESC, taxon LIMIT 25) t USING (taxon)),
k AS (SELECT 1 - 2 * count(*) FILTER (WHERE a.ry > b.ry) / count(*) AS tau FROM h a JOIN h b ON a.rx < b.rx)
SELECT (SELECT count(*) FROM s) AS shared, (SELECT count(*) FROM j WHERE y IS NULL) AS lost, (SELECT count(*) FROM j WHERE x IS NULL) AS gained, round(spearman, 6) AS spearman, round(pearson, 6) AS pearson,
round(r[len(r) // 2 + 1], 6) AS ratio_median, round(r[len(r) // 20 + 1], 6) AS ratio_low, round(r[least(len(r) - 1, len(r) * 19 // 20) + 1], 6) AS ratio_high, round(tau, 6) AS tau FROM r, k""")
def profile_compare(spark: SparkSession, d: str) -> DataFrame:
    got = ec.compare_profiles(*_halves(spark, d))
    return got.select("shared", "lost", "gained", *[_r(c) for c in ("spearman", "pearson", "ratio_median", "ratio_low", "ratio_high", "tau")])


@query("identity_deltas", """WITH q AS (SELECT l_returnflag = 'R' AS back, l_partkey AS taxon, 90 + round(avg(l_discount) * 100, 6) AS ani FROM lineitem GROUP BY ALL),
x AS (SELECT b.ani - a.ani AS delta FROM q a JOIN q b ON a.taxon = b.taxon AND NOT a.back AND b.back), l AS (SELECT list(delta ORDER BY delta) AS l FROM x)
SELECT len(l) AS n, round(l[len(l) // 2 + 1], 6) AS median, round(l[1], 6) AS least, round(l[-1], 6) AS most FROM l""")
def identity_deltas(spark: SparkSession, d: str) -> DataFrame:
    line = I.table(spark, d, "lineitem").groupBy((F.col("l_returnflag") == "R").alias("back"), F.col("l_partkey").alias("taxon")).agg((90 + F.round(F.avg("l_discount") * 100, 6)).alias("ani"))
    got = ec.identity_deltas(line.filter("not back"), line.filter("back"))
    return got.select("n", _r("median"), _r("least"), _r("most"))


# Catalogues: a part is in a region's catalogue if the region supplies a quarter of its line items.
_CAT = """c AS (SELECT l_partkey AS genome, r_name AS biome, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL),
cs AS (SELECT genome, biome, n AS prevalence, sum(n) OVER (PARTITION BY genome) AS total FROM c),
cat AS (SELECT genome, p_name AS species, biome, CAST(total AS BIGINT) AS n_kmers, prevalence FROM cs JOIN part ON p_partkey = genome WHERE prevalence >= 0.25 * total)"""


def _catalogue(spark, d):
    c = I.supply(spark, d).groupBy(F.col("l_partkey").alias("genome"), F.col("r_name").alias("biome")).agg(F.count(F.lit(1)).alias("prevalence"))
    c = c.withColumn("n_kmers", F.sum("prevalence").over(Window.partitionBy("genome"))).filter("prevalence >= 0.25 * n_kmers")
    return c.join(I.taxonomy(spark, d).select("genome", F.col("name").alias("species")), "genome")


@query("derep_species", f"WITH {_CAT} SELECT species, arg_max(genome, {{'n': n_kmers, 'g': genome}}) AS genome, max(n_kmers) AS n_kmers, array_to_string(list_sort(list(DISTINCT biome)), ',') AS biomes, count(DISTINCT genome) AS genomes FROM cat GROUP BY species")
def derep_species(spark: SparkSession, d: str) -> DataFrame:
    return sc.dereplicate(_catalogue(spark, d))


@query("exclusive_species", f"WITH {_CAT} SELECT genome AS species, min(biome) AS biome FROM cat GROUP BY genome HAVING count(DISTINCT biome) = 1")
def exclusive_species(spark: SparkSession, d: str) -> DataFrame:
    return sc.exclusive(_catalogue(spark, d).withColumn("species", F.col("genome")))


@query("marker_topn", f"""WITH {_CAT}, e AS (SELECT genome, min(biome) AS biome FROM cat GROUP BY genome HAVING count(DISTINCT biome) = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY biome ORDER BY prevalence DESC, n_kmers DESC, genome) AS place FROM cat), t AS (SELECT * FROM f WHERE place <= 20),
x AS (SELECT c.*, row_number() OVER (PARTITION BY c.biome ORDER BY prevalence DESC, n_kmers DESC, c.genome) AS place FROM cat c SEMI JOIN e ON e.genome = c.genome AND e.biome = c.biome ANTI JOIN t ON t.genome = c.genome AND t.biome = c.biome)
SELECT biome, genome, 'prevalent' AS kind FROM t UNION ALL SELECT biome, genome, 'exclusive' FROM x WHERE place <= 10""")
def marker_topn(spark: SparkSession, d: str) -> DataFrame:
    return sc.top_markers(_catalogue(spark, d).withColumn("species", F.col("genome")), 20, 10)


_SCORES = f"""{AB}, {_CAT}, mk AS (SELECT genome, list_sort(list(DISTINCT biome)) AS biomes FROM cat GROUP BY genome),
jr AS (SELECT sample, ab.genome, round(value, 6) AS value, 90 + p_size / 5 AS ani, biomes, unnest(biomes) AS biome FROM ab JOIN mk USING (genome) JOIN part ON p_partkey = genome),
scores AS (SELECT sample, biome, CAST(round(sum(CAST(value AS DECIMAL(20,6))), 4) AS DOUBLE) AS taxo, CAST(round(sum(CASE WHEN len(biomes) = 1 THEN CAST(value AS DECIMAL(20,6)) ELSE 0 END), 4) AS DOUBLE) AS excl, count(*) AS n, count(*) FILTER (WHERE ani >= 97) AS n_hi, max(value) AS best, arg_max(genome, {{'v': value, 'g': -genome}}) AS top FROM jr GROUP BY ALL)"""


def _scores(spark, d):
    markers = _catalogue(spark, d).groupBy("genome").agg(F.sort_array(F.collect_set("biome")).alias("biomes"))
    ani = I.table(spark, d, "part").select(F.col("p_partkey").alias("genome"), (90 + F.col("p_size") / 5).alias("ani"))
    scores = sc.biome_scores(I.abundance(spark, d).select("sample", "genome", _r("value")).join(ani, "genome"), markers)
    return scores.withColumns({c: F.round(c, 4).cast("double") for c in ("taxo", "excl")})


@query("screen_scores", f"WITH {_SCORES} SELECT * FROM scores")
def screen_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


@query("screen_verdict", f"""WITH {_SCORES}, o AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY excl DESC, taxo DESC, biome) AS place FROM scores),
l AS (SELECT sample, biome, excl, taxo FROM o WHERE place = 1)
SELECT l.sample, l.biome, l.excl, l.taxo, max(o.biome) FILTER (WHERE place = 2) AS runner_up, coalesce(array_to_string((list(o.biome ORDER BY place) FILTER (WHERE place > 1 AND o.taxo >= 0.75 * l.taxo))[1:4], ','), '') AS near_ties, l.excl >= 1 AS confident
FROM l JOIN o ON o.sample = l.sample GROUP BY ALL""")
def screen_verdict(spark: SparkSession, d: str) -> DataFrame:
    return sc.verdict(_scores(spark, d))


@query("marker_join", f"WITH {AB}, {_CAT}, mk AS (SELECT CAST(genome AS VARCHAR) || CASE WHEN n_kmers > 30 THEN '.gz' ELSE '' END AS key, count(*) AS biomes FROM cat GROUP BY ALL) SELECT count(*) AS n_rows, count(*) FILTER (WHERE biomes IS NULL) AS misses, CAST(sum(biomes) AS BIGINT) AS biomes FROM ab LEFT JOIN mk ON regexp_replace(key, '\\.gz$', '') = CAST(genome AS VARCHAR)")
def marker_join(spark: SparkSession, d: str) -> DataFrame:
    """Profile rows and markers whose file names differ in .gz; misses are counted."""
    gz = F.when(F.col("n_kmers") > 30, ".gz").otherwise("")
    markers = _catalogue(spark, d).groupBy(F.concat(F.col("genome").cast("string"), gz).alias("key")).agg(F.count(F.lit(1)).alias("biomes"))
    rows = I.abundance(spark, d).withColumn("key", F.col("genome").cast("string"))
    joined = rows.join(markers.withColumn("key", sc.without_gz(F.col("key"))), "key", "left")
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("biomes").isNull()).alias("misses"), F.sum("biomes").alias("biomes"))


@query("lineage_join", f"WITH {AB} SELECT sample, genome, coalesce(p_type, 'unplaced') AS type, coalesce(p_brand, 'unplaced') AS brand FROM ab LEFT JOIN part ON p_partkey = genome AND p_size > 5")
def lineage_join(spark: SparkSession, d: str) -> DataFrame:
    """Lineages of parts above size 5; others stay, as unplaced."""
    part = I.table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("genome"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))
    return I.abundance(spark, d).join(part, "genome", "left").select("sample", "genome", F.coalesce("type", F.lit("unplaced")).alias("type"), F.coalesce("brand", F.lit("unplaced")).alias("brand"))


@query("group_join", "SELECT n_name AS sample, c_mktsegment AS grp, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def group_join(spark: SparkSession, d: str) -> DataFrame:
    nation = I.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("sample"))
    joined = I.table(spark, d, "customer").join(nation, "c_nationkey", "left")
    return joined.groupBy("sample", F.col("c_mktsegment").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("abundance_rank", f"WITH {AB}, r AS (SELECT sample, genome, round(value, 9) AS value FROM ab) SELECT sample, genome, value, row_number() OVER (PARTITION BY sample ORDER BY value DESC, genome) AS place FROM r")
def abundance_rank(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("value"), "genome"))
    return I.abundance(spark, d).select("sample", "genome", _r("value", 9)).withColumn("place", place)


@query("dominant_taxon", f"WITH {_BR6} SELECT sample, arg_min(taxon, {{'v': -value, 't': taxon}}) AS taxon, round(max(value) / sum(value) * 100, 4) AS share FROM b6 GROUP BY sample")
def dominant_taxon(spark: SparkSession, d: str) -> DataFrame:
    rows = _rounded(spark, d).groupBy("sample").agg(F.min_by("taxon", F.struct(-F.col("value"), F.col("taxon"))).alias("taxon"), (F.max("value") / F.sum("value") * 100).alias("share"))
    return rows.select("sample", "taxon", _r("share", 4))


@query("ternary_xy", f"""WITH {AB}, {TAX}, s AS (SELECT sample, {', '.join(f"coalesce(sum(value) FILTER (WHERE {_POLE} = '{k}'), 0) AS {k}" for k in POLES)} FROM ab JOIN tax USING (genome) GROUP BY sample)
SELECT sample, round((P + R / 2) / (B + P + R), 6) AS x, round(R / (B + P + R) * sqrt(3) / 2, 6) AS y FROM s""")
def ternary_xy(spark: SparkSession, d: str) -> DataFrame:
    split = ec.marker_split(_taxon_rows(spark, d, "type"), POLES)
    x = (F.col("sum_P") + F.col("sum_R") / 2) / F.col("markers")
    y = F.col("sum_R") / F.col("markers") * F.sqrt(F.lit(3.0)) / 2
    return split.select("sample", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("matrix_upsert", "WITH r AS (SELECT n_name AS sample, l_partkey AS genome, {'at': l_orderkey * 10 + l_linenumber, 'v': l_quantity} AS x FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey) SELECT genome, sample, max(x).v AS value FROM r GROUP BY ALL")
def matrix_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Line items as writes to cells; of those to one cell the last order's stays."""
    rows = I.supply(spark, d).select(F.col("l_partkey").alias("genome"), F.col("n_name").alias("sample"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_quantity").alias("value"), "l_returnflag")
    return mx.upsert(rows.filter("l_returnflag <> 'R'").drop("l_returnflag"), rows.filter("l_returnflag = 'R'").drop("l_returnflag"))


@query("distinct_union", f"WITH {_CAT} SELECT genome FROM cat WHERE biome = (SELECT min(r_name) FROM region) UNION SELECT genome FROM cat WHERE biome = (SELECT max(r_name) FROM region)")
def distinct_union(spark: SparkSession, d: str) -> DataFrame:
    cat, ends = _catalogue(spark, d), I.table(spark, d, "region").agg(F.min("r_name").alias("a"), F.max("r_name").alias("b")).first()
    pick = lambda b: cat.filter(F.col("biome") == b).select("genome")
    return pick(ends["a"]).union(pick(ends["b"])).distinct()


@query("matrix_checks", f"""WITH {AB}, s AS (SELECT sample, sum(value) AS total, count(*) AS n, count(DISTINCT genome) AS genomes FROM ab GROUP BY sample), z AS (SELECT genome FROM ab GROUP BY genome HAVING max(value) > 0)
SELECT count(*) AS samples, count(*) FILTER (WHERE abs(total - 100) <= 0.5) AS sums_ok, count(*) FILTER (WHERE n = genomes) AS unique_ok, (SELECT count(*) FROM z) AS nonzero_rows, (SELECT count(*) FROM z ANTI JOIN part ON p_partkey = genome) AS unplaced FROM s""")
def matrix_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = I.abundance(spark, d)
    per = rows.groupBy("sample").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"), F.count_distinct("genome").alias("genomes"))
    checks = per.agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.abs(F.col("total") - 100) <= 0.5).alias("sums_ok"), F.count_if(F.col("n") == F.col("genomes")).alias("unique_ok"))
    placed = I.taxonomy(spark, d).select("genome", F.lit(True).alias("placed"))
    shown = rows.groupBy("genome").agg(F.max("value").alias("top")).filter("top > 0").join(placed, "genome", "left")
    return checks.join(shown.agg(F.count(F.lit(1)).alias("nonzero_rows"), F.count_if(F.col("placed").isNull()).alias("unplaced")))


@query("resumed_matrix", f"WITH {AB} SELECT sample, genome, round(value, 9) AS value, true AS finished FROM ab")
def resumed_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The abundance matrix in blocks of ten samples, one of which fails once: a second run does what is left."""
    from ..streaming.resumable import grown_table, run_plan

    rows = stored(I.abundance(spark, d))
    plan, path, tried = rows.select("sample").distinct(), scratch(spark), []

    def work(some: DataFrame) -> DataFrame:
        tried.append(some.count())
        if len(tried) in (2, 3):
            raise RuntimeError("lost")
        return rows.join(some, "sample", "left_semi")

    while run_plan(plan, work, path, step=10):
        pass
    return grown_table(plan, path, "sample string, genome long, value double").select("sample", "genome", F.round("value", 9).alias("value"), "finished")
