"""Connected components by alternating large-star and small-star steps, all as grouped minima and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u long, v long) -> (node, root): root is the smallest node of the component; nodes without edges are absent.

    Loops, repeated edges and either direction are allowed, nulls are dropped, no edges give no rows.
    Each step is linear in the edges; a hub's rows are pre-aggregated or met in a join that may be split. Raises if `most_rounds` steps (about log n are needed) don't reach the fixpoint.
    """
    with Scratch(edges.sparkSession) as scratch:
        e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e, seen = scratch.written(e, "round0"), None
        for turn in range(most_rounds):
            told = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if not told[0] or told == seen:
                break
            seen = told
            e = scratch.written(_small_star(_large_star(e)), f"round{turn + 1}")
            scratch.free(f"round{turn}")
        else:
            raise RuntimeError(f"components: no fixpoint in {most_rounds} rounds")
        return written(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v"))).distinct(), "components")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v"), F.col("u")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("m", "u").alias("m"))
    return both.join(low, both.u == low.hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    hub = low.withColumnRenamed("u", "hub")
    moved = e.join(hub, e.u == hub.hub).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", "m")).distinct()
