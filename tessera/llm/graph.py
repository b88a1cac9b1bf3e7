"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, stored

#: The rounds grow with the logarithm of the longest path; far more than any input needs.
MAX_ROUNDS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node (larger ones, or the others with the node itself) to its least neighbour.

    The minimum is an aggregate with partial sums, and the edges meet it in a join: the many edges of a hub are
    nowhere gathered in one task by a window or a list.
    """
    flip = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.union(flip) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    met = near.join(least, F.col("u") == F.col("k"))
    if large:
        return met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    return met.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v), root being the least node of its component."""
    now = stored(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        last, now = now, stored(_star(_star(now, True), False), "star")
        forget(last)
        new = now.agg(F.count(F.lit(1)).alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(20, 0)))").alias("h")).first()
        if mark == (new["n"], new["h"]):
            break
        mark = (new["n"], new["h"])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
