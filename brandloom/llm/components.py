"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom.llm.common import discard, stage


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node's larger neighbours point to its least neighbour or itself; and the staged minima.

    The minima are staged: both sides of the join then come from plain shuffles,
    so Spark can split the partition of a node with very many neighbours.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), least


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of `edges` (a, b): the least id it reaches.

    No node's neighbours are ever gathered: each step is a minimum and an equi
    join, both of which Spark splits for a node with many edges. Self-links
    and repeated or reversed edges are welcome; no edges give no rows.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # the same edges again: every node points to the least of its component
        figures = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if figures == before or not figures["n"]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
        before = figures
        large, least = _large(now)
        new = stage(_small(large), "stars")
        discard(least, now)
        now = new
