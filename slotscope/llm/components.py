"""Connected components by alternating large-star and small-star steps, on the cluster alone.

The centre of a large star is a hot key. Its smallest neighbour is found by an aggregation that combines in the map tasks, and cut, so that the
join with its neighbours shuffles both sides anew: Spark then splits the hot partition or broadcasts the small side.

Edges grow fewer from step to step, so what a step leaves is kept in as many partitions as its edges ask for: few edges in ever so many
partitions would cost each shuffle after it a file a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotscope.llm.shared import cut

#: Edges that a task may hold.
EDGES_A_TASK = 1 << 18


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every neighbour larger than u is tied to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks))
    return cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks))


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return cut(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v) but the roots themselves; a root is its component's smallest node."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    state = _state(now)
    while state[0]:
        tasks = 1 + state[0] // EDGES_A_TASK
        now = _small_star(_large_star(now, tasks), tasks)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
