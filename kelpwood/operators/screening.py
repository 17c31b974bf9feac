"""Screening: which catalogue of genomes suits a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Endings of names that are fallbacks to a higher rank.
FALLBACKS = [" sp.", "(family)", "(order)", "(class)", "(phylum)", "(domain only)"]


def without_gz(key: Column) -> Column:
    return F.regexp_replace(key, r"\.gz$", "")


def is_named(species: Column) -> Column:
    """A real species name, and no fallback."""
    named = (F.length(F.coalesce(species, F.lit(""))) > 0) & (species != "unclassified")
    for ending in FALLBACKS:
        named = named & ~species.endswith(ending)
    return F.coalesce(named, F.lit(False))


def dereplicate(genomes: DataFrame) -> DataFrame:
    """(genome, species, biome, n_kmers) to one genome of each species, that with
    the most k-mers (of equals the largest genome), and its species' biomes."""
    best = genomes.groupBy("species").agg(F.max(F.struct("n_kmers", "genome")).alias("best"), F.array_join(F.sort_array(F.collect_set("biome")), ",").alias("biomes"), F.count_distinct("genome").alias("genomes"))
    return best.select("species", F.col("best.genome").alias("genome"), F.col("best.n_kmers").alias("n_kmers"), "biomes", "genomes")


def exclusive(genomes: DataFrame) -> DataFrame:
    """(species, biome) of species that occur in one catalogue only."""
    return genomes.groupBy("species").agg(F.count_distinct("biome").alias("n"), F.min("biome").alias("biome")).filter("n = 1").select("species", "biome")


def top_markers(genomes: DataFrame, n: int, quota: int) -> DataFrame:
    """(biome, genome, kind): each catalogue's n genomes of the highest prevalence
    (then n_kmers, then the smallest genome), and up to ``quota`` more exclusive ones."""
    order = Window.partitionBy("biome").orderBy(F.desc("prevalence"), F.desc("n_kmers"), "genome")
    first = genomes.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    own = genomes.join(exclusive(genomes), ["species", "biome"], "left_semi").join(first.select("biome", "genome"), ["biome", "genome"], "left_anti")
    extra = own.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= quota)
    return first.select("biome", "genome", F.lit("prevalent").alias("kind")).unionByName(extra.select("biome", "genome", F.lit("exclusive").alias("kind")))


def biome_scores(profile: DataFrame, markers: DataFrame) -> DataFrame:
    """Profile rows (sample, genome, value, ani) and markers (genome, biomes) to,
    for each sample and catalogue: taxo (abundance of its genomes), excl (of those
    in no other; both are decimals of six places), n, n_hi (identity of 97 or more), best and top (largest genome)."""
    # Sums of decimals don't depend on their order.
    profile = profile.withColumn("value", F.col("value").cast("decimal(20,6)"))
    joined = profile.join(markers, "genome").withColumn("alone", F.size("biomes") == 1)
    rows = joined.select("*", F.explode("biomes").alias("biome"))
    return rows.groupBy("sample", "biome").agg(
        F.sum("value").alias("taxo"), F.sum(F.when(F.col("alone"), F.col("value")).otherwise(0)).alias("excl"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ani") >= 97).alias("n_hi"), F.max("value").cast("double").alias("best"), F.max_by("genome", F.struct(F.col("value"), -F.col("genome"))).alias("top"),
    )


def verdict(scores: DataFrame, confident: float = 1.0, near: float = 0.75, most: int = 4) -> DataFrame:
    """The catalogue of each sample: the largest exclusive abundance, then the
    largest abundance; whether that is confident; the runner-up; and the others
    (``most`` at most) whose abundance comes near the best's."""
    order = Window.partitionBy("sample").orderBy(F.desc("excl"), F.desc("taxo"), "biome")
    ranked = scores.withColumn("place", F.row_number().over(order)).withColumn("lead", F.first("taxo").over(order))
    closest = F.filter(F.array_sort(F.collect_list(F.when((F.col("place") > 1) & (F.col("taxo") >= near * F.col("lead")), F.struct("place", "biome")))), lambda x: x.isNotNull())
    return ranked.groupBy("sample").agg(
        F.max(F.when(F.col("place") == 1, F.col("biome"))).alias("biome"), F.max(F.when(F.col("place") == 1, F.col("excl"))).alias("excl"),
        F.max(F.when(F.col("place") == 1, F.col("taxo"))).alias("taxo"), F.max(F.when(F.col("place") == 2, F.col("biome"))).alias("runner_up"),
        F.array_join(F.transform(F.slice(closest, 1, most), lambda x: x["biome"]), ",").alias("near_ties"),
    ).withColumn("confident", F.col("excl") >= confident)
