"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.session import remove_folder, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = (both.groupBy("u").agg(F.min("v").alias("m"))
           .select("u", F.least("u", "m").alias("m")))
    return (both.where(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = (down.join(low, "u").where(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    kept = low.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v",
                         max_rounds: int = 64) -> DataFrame:
    """``node, component`` for every node of an edge; component = smallest node.

    Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
    Minima are partial aggregates, so a hub is reduced before it is shuffled;
    the joins attach one row per node, which AQE may split on the hub's side.
    Each round ends in a reliable checkpoint that replaces the one before, and
    the stop test is one aggregate row. Rounds grow with the logarithm of the
    longest chain.
    """
    spark = edges.sparkSession
    current, folder = staged(edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
                             .where(F.col("u") != F.col("v")).distinct(), "edges")
    digest = None
    for _ in range(max_rounds if current.take(1) else 0):
        before = folder
        current, folder = staged(_small_star(_large_star(current)), "edges")
        remove_folder(spark, before)
        row = current.agg(F.count("*").alias("n"),
                          F.bit_xor(F.xxhash64("u", "v")).alias("h"),
                          F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if tuple(row) == digest:
            break
        digest = tuple(row)
    else:
        if current.take(1):
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
