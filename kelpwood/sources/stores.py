"""Sketches, sessions and tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import scratch  # noqa: F401

def stored(df: DataFrame) -> DataFrame:
    """df written once to shared storage and read back: what is used several times
    is made once, and a lost executor costs no more than its tasks."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_sketch(sketch: DataFrame, path: str, k: int, c: int, min_spacing: int) -> None:
    """(genome, h, used) in the order of h, with the settings as columns: a reader
    at a coarser c then skips whole row groups by their least hash."""
    rows = sketch.withColumns({"k": F.lit(k), "c": F.lit(c), "min_spacing": F.lit(min_spacing)})
    rows.repartitionByRange("h").sortWithinPartitions("h").write.parquet(path)


def read_sketch(spark: SparkSession, path: str, k: int, c: int) -> DataFrame:
    """A database for settings k and c. Its own k must be equal, and its own c at
    most c, all through; it is thinned if it is finer."""
    from ..functions.kmers import threshold

    rows = spark.read.parquet(path)
    odd = rows.filter((F.col("k") != k) | (F.col("c") > c)).select("k", "c").first()
    if odd:
        raise ValueError(f"a database of k={odd['k']}, c={odd['c']} can't serve k={k}, c={c}")
    return rows.filter(F.col("h") < threshold(c)).select("genome", "h", "used")


def write_samples(samples: DataFrame, path: str, k: int, c: int) -> None:
    """Sample sketches (sample, h, cnt), one folder a sample, with their settings as columns.
    A large sample has several files, as many as its size asks for, not a fixed number."""
    rows = samples.withColumns({"k": F.lit(k), "c": F.lit(c), "part": F.pmod("h", F.lit(16))})
    rows.hint("rebalance", "sample", "part").drop("part").sortWithinPartitions("sample", "h").write.partitionBy("sample").parquet(path)


def read_samples(spark: SparkSession, path: str, k: int, c: int) -> DataFrame:
    """Sample sketches for databases of settings k and c: their own k must be
    equal, and their own c at most c; they are thinned if they are finer."""
    from ..functions.kmers import threshold

    rows = spark.read.parquet(path)
    odd = rows.filter((F.col("k") != k) | (F.col("c") > c)).select("k", "c").first()
    if odd:
        raise ValueError(f"samples of k={odd['k']}, c={odd['c']} can't be held against k={k}, c={c}")
    return rows.filter(F.col("h") < threshold(c)).select(F.col("sample").cast("string").alias("sample"), "h", "cnt")


def merge_stored(spark: SparkSession, paths: dict[str, str], path: str) -> DataFrame:
    """Stored databases, by their names, merged into one at ``path``; they must agree
    on k, c and min_spacing. Of a genome that several have, the first one's stays."""
    from ..operators.sketch import merge_sketches

    parts = {name: spark.read.parquet(p) for name, p in paths.items()}
    settings = None
    for name, rows in parts.items():
        for r in rows.select("k", "c", "min_spacing").distinct().limit(2).collect():
            if settings is None:
                settings = r
            elif r != settings:
                raise ValueError(f"{name} has {r.asDict()}, others {settings.asDict()}: a database must be of one kind")
    merged = merge_sketches(*parts.items())
    if settings is not None:
        write_sketch(merged.select("genome", "h", "used"), path, settings["k"], settings["c"], settings["min_spacing"])
    return merged
