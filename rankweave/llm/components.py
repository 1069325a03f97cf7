"""Connected components by alternating stars, on DataFrames: no graph, link or component passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import stored

#: Edges of a file of the stars, about; a round writes as many files as its edges need, whatever the number of shuffle partitions.
EDGES = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the node's least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    return down.join(least, "a").select("b", F.col("least")).unionByName(least.select(F.col("a").alias("b"), "least")).where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (its least node) for the nodes of edges (a, b of a type with order); nodes without edges aren't listed.

    edges are counted first, so they should be a stored table. Raises if the stars aren't stable after so many rounds.
    """
    files = edges.count() // EDGES + 1  # a round adds no edges
    now = stored(edges.select("a", "b").where("a <> b").distinct().coalesce(files), "stars")
    state = None
    for _ in range(rounds):
        now = stored(_small_star(_large_star(now)).distinct().coalesce(files), "stars")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components aren't settled after {rounds} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
