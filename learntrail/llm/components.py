"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learntrail.llm.common import drop_written, join_hot, written


def _settled(edges: DataFrame) -> tuple[bool, int]:
    """Whether every id points to one other id only, and none of those points on (then the edges are the answer), and the number of edges."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("in")).unionAll(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    row = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("in").alias("in")).agg(F.count_if(F.col("out") + F.col("in") > 1), F.sum("out")).first()
    return row[0] == 0, row[1] or 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` has two long columns, ``u`` and ``v``. Returns ``id, component``, the least id reachable, for every id on an edge.

    Each round is two joins against one aggregated row a node, which is broadcast for the few nodes with very many neighbours,
    so that their edges are never gathered; the number of rounds grows with the logarithm of the longest path. Each round's edges are written to the shared folder.
    Nulls and self-loops are dropped; an empty table gives an empty table.
    """
    state = written(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        done, n = _settled(state)
        if done:
            break
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both.where("v > u"), least, ["u"], "n", "inner", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low, ["u"], "n", "inner", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        drop_written(state)
        state = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = state.select(F.col("v").alias("id")).distinct()
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops.select("id", F.col("id").alias("component")))
