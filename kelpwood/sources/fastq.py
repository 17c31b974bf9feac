"""FASTA and FASTQ: files, whole texts, pairs of mates and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sequences import numbered, read_sequences


def fastq_records(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Whole FASTQ texts to their records: the other columns, idx, name, seq, qual, ok.

    A record is four lines; it is ok if the first starts with @, the third with +,
    and qualities are as long as the bases. A last line end may be missing; lines
    that make no whole record are a record that is not ok. One row stays one
    task's work, without a shuffle.
    """
    lines = F.split(F.regexp_replace(F.regexp_replace(text_col, "\r\n", "\n"), "\n$", ""), "\n")
    keep = [c for c in texts.columns if c != text_col]
    rows = texts.filter(F.length(text_col) > 0).select(*keep, lines.alias("lines"))
    line = lambda i, k: F.try_element_at("lines", (i * 4 + k).cast("int"))

    def record(i: Column) -> Column:
        whole = line(i, 1).startswith("@") & line(i, 3).startswith("+") & (F.length(line(i, 2)) == F.length(line(i, 4)))
        return F.struct(i.cast("long").alias("idx"), F.substring_index(F.substring(line(i, 1), 2, 1 << 30), " ", 1).alias("name"), line(i, 2).alias("seq"), line(i, 4).alias("qual"), F.coalesce(whole, F.lit(False)).alias("ok"))

    n = F.ceil(F.size("lines") / 4)
    return rows.select(*keep, F.inline(F.transform(F.sequence(F.lit(0), n - 1), record)))


def until_broken(records: DataFrame, by: list[str]) -> DataFrame:
    """The records before the first that is not ok, of each text."""
    bad = records.filter(~F.col("ok")).groupBy(*by).agg(F.min("idx").alias("bad"))
    return records.join(bad, by, "left").filter(F.col("bad").isNull() | (F.col("idx") < F.col("bad"))).drop("bad")


def capped(records: DataFrame, by: str, order: str, size: str, most_records: int, most_bases: int, block: int = 4096) -> DataFrame:
    """The first records of each file, until ``most_records`` are read or those read
    hold ``most_bases``; the record that reaches the bases is whole.

    Running sums are made in two levels, over blocks of the order and within
    each, so a large file is not one task's work.
    """
    rows = records.withColumn("block_", F.floor(F.col(order) / block))
    blocks = rows.groupBy(by, "block_").agg(F.sum(size).alias("s_"), F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(by).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(by, "block_", F.coalesce(F.sum("s_").over(before), F.lit(0)).alias("s_before"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("n_before"))
    inner = Window.partitionBy(by, "block_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"s_": F.coalesce(F.sum(size).over(inner), F.lit(0)), "n_": F.row_number().over(Window.partitionBy(by, "block_").orderBy(order)) - 1})
    joined = rows.join(blocks, [by, "block_"])
    return joined.filter((F.col("n_") + F.col("n_before") < most_records) & (F.col("s_") + F.col("s_before") < most_bases)).select(*records.columns)


def mates(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Records of both sides with the same ordinal: it ends where either side does."""
    return left.join(right, by)


def write_fastq(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Records (name, seq, qual) as FASTQ files, one for each partition, by Spark's text writer."""
    lines = F.concat_ws("\n", F.concat(F.lit("@"), F.col("name")), "seq", F.lit("+"), "qual")
    records.select(lines.alias("value")).write.option("compression", compression).text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """FASTQ or FASTA files, plain or gzip by their first bytes: path, idx,
    name, seq, qual, ok. FASTA records have null qualities. Lines that make no record are a row
    that is not ok, and reading goes on; until_broken() ends a file there."""
    return numbered(read_sequences(spark, path)).select("path", "idx", "name", "seq", "qual", "ok")
