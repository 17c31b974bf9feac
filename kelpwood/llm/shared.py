"""Small helpers that the operators of this subpackage have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwood.functions.scratch import passing  # noqa: F401
from kelpwood.functions.scratch import scratch as shared_folder  # noqa: F401
from kelpwood.functions.workers import map_arrow, ship  # noqa: F401

def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df once and read it back: cuts the lineage, and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, rows: int, per_part: int) -> DataFrame:
    """df in as many partitions as ``rows`` rows need, if it has more: small tables make few files."""
    return df.coalesce(max(1, -(-rows // per_part)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fresh(name: str, taken) -> str:
    """A column name that clashes with none of those taken."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name
