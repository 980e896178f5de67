"""Connected components over edges that may not fit one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
    return row["n"], row["h"]


def star_forest(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (u, v) with v the smallest id that u reaches, for every u that is not smallest itself.

    Alternating large-star and small-star rounds: each is a grouped minimum and a join, so a hub
    is pre-aggregated map-side and its rows can be split by the adaptive skew join. The number of
    rounds grows with the logarithm of the graph's size. Every round is written to the shared folder.
    """
    linked = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    linked = materialise(linked, "links")
    before = _signature(linked)
    while before[0]:
        both = linked.unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Stars move links and drop some, so there are no more than before.
        linked = materialise(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links", rows=before[0])
        after = _signature(linked)
        if after == before:
            break
        before = after
    return linked
