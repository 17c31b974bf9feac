"""Abundance tables: long (sample, genome, value), absent means zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relative(rows: DataFrame, value: str = "value") -> DataFrame:
    """value in percent of its sample."""
    return rows.withColumn(value, F.col(value) / F.sum(value).over(Window.partitionBy("sample")) * 100)


def roll_up(rows: DataFrame, taxonomy: DataFrame, rank: str) -> DataFrame:
    """(sample, taxon, value, genomes): sums at a rank; a genome without one is
    "unclassified at <rank> level"."""
    joined = rows.join(taxonomy.select("genome", F.col(rank).alias("taxon")), "genome", "left")
    taxon = F.coalesce("taxon", F.lit(f"unclassified at {rank} level")).alias("taxon")
    return joined.groupBy("sample", taxon).agg(F.sum("value").alias("value"), F.count_distinct("genome").alias("genomes"))


def pivot(rows: DataFrame, samples: list[str], key: str = "taxon") -> DataFrame:
    """A column for each of the samples, rows by their largest value; the list of
    samples is given, so the table is read once."""
    wide = rows.groupBy(key).pivot("sample", samples).agg(F.sum("value")).fillna(0.0)
    return wide.withColumn("max_abundance", F.greatest(*[F.col(f"`{s}`") for s in samples])).orderBy(F.desc("max_abundance"), key)


def species_labels(names: DataFrame) -> DataFrame:
    """(genome, name) to labels: the name, with the genome if several share it,
    or the genome in brackets if it has none."""
    shared = names.filter(F.col("name").isNotNull()).groupBy("name").agg((F.count(F.lit(1)) > 1).alias("shared"))
    g = F.col("genome").cast("string")
    label = F.when(F.col("name").isNull(), F.concat(F.lit("("), g, F.lit(")"))).when(F.col("shared"), F.concat("name", F.lit(" ["), g, F.lit("]"))).otherwise(F.col("name"))
    return names.join(shared, "name", "left").select("genome", label.alias("label"))


def clade_table(rows: DataFrame, taxonomy: DataFrame, ranks: dict[str, str]) -> DataFrame:
    """(clade, depth, sample, value): cumulative up the lineage. ranks maps a column
    to its prefix, coarse to fine; clades are prefixed names joined by "|"."""
    joined = rows.join(taxonomy, "genome")
    parts = [F.concat(F.lit(p + "__"), F.replace(F.col(c), F.lit(" "), F.lit("_"))) for c, p in ranks.items()]
    clades = F.array(*[F.struct(F.lit(i + 1).alias("depth"), F.concat_ws("|", *parts[: i + 1]).alias("clade")) for i in range(len(parts))])
    return joined.select("sample", "value", F.explode(clades).alias("c")).groupBy("c.clade", "c.depth", "sample").agg(F.sum("value").alias("value"))


def biom_rows(rows: DataFrame, samples: list[str], key: str = "taxon") -> DataFrame:
    """One JSON object for each row of a dense BIOM 1.0 table."""
    wide = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("sample", F.round("value", 6)))).alias("m"))
    values = F.array(*[F.coalesce(F.try_element_at("m", F.lit(s)), F.lit(0.0)) for s in samples])
    return wide.select(key, values.alias("data"))


def labelled_concat(samples: DataFrame, name: Column) -> DataFrame:
    """Engine rows of several samples in one table, under the samples' own names."""
    return samples.withColumn("sample_file", name)


def upsert(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows with new's values for (genome, sample); among several, the largest ``at`` wins."""
    both = rows.unionByName(new)
    return both.groupBy("genome", "sample").agg(F.max(F.struct("at", "value")).alias("last")).select("genome", "sample", F.col("last.value").alias("value"))


def top_and_other(rows: DataFrame, n: int, per_sample: bool, key: str = "taxon") -> DataFrame:
    """(sample, taxon, share): the n largest taxa, of all samples or of each, and
    "other" for the rest, in percent of the sample."""
    if per_sample:
        place = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("value"), key))
        named = rows.withColumn("shown", F.when(place <= n, F.col(key)).otherwise("other"))
    else:
        totals = rows.groupBy(key).agg(F.sum("value").alias("total"))
        top = totals.orderBy(F.desc("total"), key).limit(n).select(F.col(key).alias("shown"))
        named = rows.join(F.broadcast(top), F.col(key) == F.col("shown"), "left").withColumn("shown", F.coalesce("shown", F.lit("other")))
    sums = named.groupBy("sample", "shown").agg(F.sum("value").alias("value"))
    share = F.col("value") / F.sum("value").over(Window.partitionBy("sample")) * 100
    return sums.select("sample", F.col("shown").alias(key), share.alias("share"))
