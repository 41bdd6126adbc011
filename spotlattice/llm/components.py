"""Connected components of a table of edges, by alternating large-star and small-star steps.

Every step is an aggregate and a join, and its edges are written to the shared folder, so lost executors cost one step
at most. Nothing is collected but two numbers a round, which tell whether the edges still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlattice.llm.util import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges(u, v) -> (u, v): every node with an edge but the least of its component, and that least one.

    Self-loops and repeated edges do no harm; an empty table gives an empty one.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = sign(now)
    for _ in range(most if seen[0] else 0):
        now = stored(_small_star(_large_star(now)), "edges")
        last, seen = seen, sign(now)
        if seen == last:
            return now
    if seen[0]:
        raise RuntimeError("components did not settle")
    return now
