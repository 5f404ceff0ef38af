"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govaudit.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are hung on the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are hung on the smallest of these. Edges lead downwards."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    joined = edges.join(least, "u")
    return (joined.where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
            .union(least.select("u", F.col("least").alias("v"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of every node of ``edges`` (u, v), both long.

    Loops, repeated edges and edges in both directions are fine. Each round is
    written to the shared folder; there are about log(longest path) rounds.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.expr("CAST(xxhash64(u, v) AS DECIMAL(38, 0))")).alias("h")).first()
        if state == before or not state.n:
            break
        before = state
        now = stored(_small_star(_large_star(now)), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
