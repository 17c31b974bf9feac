"""Batches of samples that can be stopped anywhere and run again, and the table that grows with them.

A plan lists samples. They are worked on in chunks; a chunk's rows are written under
a version, and then the version is committed, with the state of each of its samples.
Rows of a version that was never committed don't count, and the next run writes over
them. A later version of a sample replaces the earlier one whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "sample string, state string, reason string"
#: Characters of a failure's reason.
REASON = 300


def _there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The log: sample, state (done or failed), reason, version."""
    if not _there(spark, f"{path}/commits"):
        return spark.createDataFrame([], f"{COMMITS}, version long")
    return spark.read.schema(f"{COMMITS}, version long").parquet(f"{path}/commits")


def latest(log: DataFrame) -> DataFrame:
    """Each sample's last version that is done, or else its last failure."""
    best = F.max_by(F.struct("state", "reason", "version"), F.struct(F.col("state") == "done", "version"))
    return log.groupBy("sample").agg(best.alias("best")).select("sample", "best.state", "best.reason", "best.version")


def run_plan(plan: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, step: int = 100) -> int:
    """Work on all samples of the plan (column sample) that aren't done, ``step`` at a
    time; returns how many are not done after it.

    work gets the plan's rows of some samples and returns rows with a column sample. A
    chunk that fails is tried again sample by sample, and those that fail are
    committed with their reason; a later run tries them again, and only them.
    """
    spark = plan.sparkSession
    log = commits(spark, path)
    version = (log.agg(F.max("version")).first()[0] or 0) + 1
    left = plan.select("sample").distinct().join(log.filter("state = 'done'"), "sample", "left_anti")
    names = [r[0] for r in left.orderBy("sample").collect()]  # a plan is a list of names, made by someone
    failed = 0

    def attempt(some: list[str]) -> str | None:
        nonlocal version
        try:
            work(plan.filter(F.col("sample").isin(some))).write.mode("overwrite").parquet(f"{path}/results/version={version}")
            reason = None
        except Exception as e:  # whatever it is, it is this sample's reason
            reason = str(e).strip()[:REASON] or type(e).__name__
            if len(some) > 1:
                return reason
        rows = [(s, "done" if reason is None else "failed", reason) for s in some]
        spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/version={version}")
        version += 1
        return reason

    for at in range(0, len(names), step):
        chunk = names[at : at + step]
        if attempt(chunk) is not None:
            failed += sum(attempt([s]) is not None for s in chunk) if len(chunk) > 1 else 1
    return failed


def grown_table(plan: DataFrame, path: str, schema: str) -> DataFrame:
    """What is committed so far: the rows of each sample's last version, and one row
    with nulls for each sample of the plan that isn't done. Adds finished (boolean)."""
    spark = plan.sparkSession
    done = latest(commits(spark, path)).filter("state = 'done'")
    rows = spark.createDataFrame([], f"{schema}, version long") if not _there(spark, f"{path}/results") else spark.read.schema(f"{schema}, version long").parquet(f"{path}/results")
    held = rows.join(done.select("sample", "version"), ["sample", "version"], "left_semi").drop("version").withColumn("finished", F.lit(True))
    open_ = plan.select("sample").distinct().join(done, "sample", "left_anti").withColumn("finished", F.lit(False))
    return held.unionByName(open_, allowMissingColumns=True)

