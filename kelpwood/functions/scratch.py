"""Folders for what is stored between jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}
_INSIDE: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, in one of this application's own.

    Where that setting is missing, a session on this machine alone gets a
    temporary folder that goes with this process; on a cluster executors would
    write to their own disks, so that is an error.
    """
    app = spark.sparkContext.applicationId
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="kelpwood-")
            atexit.register(shutil.rmtree, _OWN[app], True)
        root = _OWN[app]
    return "/".join([root.rstrip("/"), f"kelpwood-{app}", *_INSIDE, uuid.uuid4().hex])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is stored inside goes at the end: store results that are to stay elsewhere, before it."""
    name = uuid.uuid4().hex
    path = scratch(spark).rsplit("/", 1)[0] + "/" + name
    _INSIDE.append(name)
    try:
        yield
    finally:
        _INSIDE.pop()
        remove(spark, path)
