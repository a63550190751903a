"""Connected components of an edge table by alternating large and small stars; every step is a grouping and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import cut


def _large(edges: DataFrame) -> DataFrame:
    """Each node hands its greater neighbours to the least node of its neighbourhood.

    The minima are written before the join: it then reads shuffled or broadcast tables alone, which adaptive execution can split, so
    that a node with very many neighbours is not one task.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node hands its lesser neighbours and itself to the least of them. Edges run from u to a lesser v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))  # u is the greater end here: no hub, which is the lesser one
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (least node reachable) for all nodes of ``edges`` (columns u, v of one orderable type).

    Null ends and loops are ignored; repeated edges count once; no edges give an empty table.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        now = cut(_small(_large(now)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
