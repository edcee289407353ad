"""Connected components by alternating large-star and small-star rounds.

Each round keeps the components and pulls every node towards its smallest
neighbour; the number of rounds grows with the logarithm of the nodes. All
steps are equi-joins and minima over edges, so no group is ever gathered, and
each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import remove, written

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, component) for the nodes of ``edges`` (a, b), and its path.

    component is the smallest node of each component. Loops and nulls among
    the edges are ignored; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    now, at = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components"
    )
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_at = written(large, "components")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lower.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after, after_at = written(small, "components")
        remove(spark, large_at)
        remove(spark, at)
        before, state = state, _state(after)
        now, at = after, after_at
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(tops), at
