"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import materialise


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges`` but the roots; the root is the smallest node reachable.

    A step moves edges towards smaller neighbours; only minima per node are gathered, and they are
    combined before the shuffle, so a node with very many edges stays cheap. Each step is written to
    the shared folder.
    """
    now = edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where("node <> root").distinct()
    now = materialise(now, "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(
            now.select(F.col("root").alias("u"), F.col("node").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("root"))
        large = materialise(large.where("node <> root").distinct(), "large-star")
        lowest = large.groupBy("node").agg(F.min("root").alias("m"))
        moved = large.join(lowest, "node").where("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        then = lowest.select("node", F.col("m").alias("root")).unionByName(moved).distinct()
        now = materialise(then, "small-star")
        before, state = state, _state(now)
        if state == before:
            break
    return now
