"""Python workers: shipping this package's code, and mapInArrow with it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "kelpwood_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow for functions that import this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def spread(table: DataFrame) -> DataFrame:
    """A table just read, dealt to all cores if its files give fewer tasks than that.

    Large tables have more splits than cores and are left as they are: no shuffle.
    Only for plain scans, whose partitions are known without running anything.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
