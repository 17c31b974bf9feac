"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gathered, shared_folder, stored

#: Rounds grow with the logarithm of a component's size; more than these are an error.
MOST_ROUNDS = 200
#: Edges of a partition, at least.
PART_EDGES = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is tied to the smallest of u and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    others = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return others.unionByName(least.select("a", F.col("least").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b: long) to (node, root): root is the smallest node reachable.

    Nodes without edges don't occur. Each round is written to the shared
    folder; the minimum of a hub's neighbours is combined inside the tasks, and
    what a hub hands on is a join that Spark can split.
    """
    folder = shared_folder(edges.sparkSession)
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/round=0")
    state, rows = None, now.count()
    for k in range(1, MOST_ROUNDS + 1):
        now = stored(gathered(_small_star(_large_star(now)), rows, PART_EDGES), f"{folder}/round={k}")
        seen = now.agg(F.count("a").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == state or not seen["n"]:
            break
        state, rows = seen, seen["n"]
    else:
        raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
