"""Spatial neighbours on the grid, as equi-joins on grid offsets; and neighbours among vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotlattice.functions.reuse import reused


def _offsets(spark, radius: int) -> DataFrame:
    span = F.sequence(F.lit(-radius), F.lit(radius))
    xs = spark.range(1).select(F.explode(span).alias("dx")).select("dx", F.explode(span).alias("dy"))
    return xs.withColumn("dist2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).where(F.col("dist2") <= radius * radius)


def knn_xy(spots: DataFrame, k: int, extent: int = 50) -> DataFrame:
    """sample, src, dst, dist2, rank, k of the k nearest spots of every spot, itself among them; ties by spot_id.

    The first disc is so large that a quarter of it holds k grid points, which is enough even at a corner. Only spots that
    do not find k in it, for holes, are tried again over the extent of the grid. So pairs grow with spots * k.
    """
    spark = spots.sparkSession
    left = spots.select("sample", F.col("spot_id").alias("src"), "x_id", "y_id")
    right = spots.select("sample", F.col("spot_id").alias("dst"), F.col("x_id").alias("px"), F.col("y_id").alias("py"))
    total = spots.groupBy("sample").agg(F.least(F.count("*"), F.lit(k)).alias("want"))
    last = math.ceil(extent * math.sqrt(2))
    by_src = W.partitionBy("sample", "src")

    def within(todo: DataFrame, radius: int) -> DataFrame:
        near = todo.join(F.broadcast(_offsets(spark, radius))).withColumns({"px": F.col("x_id") + F.col("dx"), "py": F.col("y_id") + F.col("dy")})
        return near.join(right, ["sample", "px", "py"]).withColumns({"found": F.count("*").over(by_src), "rank": F.row_number().over(by_src.orderBy("dist2", "dst"))})

    ranked = lambda df: df.where(F.col("rank") <= F.col("want")).select("sample", "src", "dst", "dist2", "rank", F.col("want").alias("k"))
    every = left.join(total, "sample")
    radius = min(2 * (math.ceil(math.sqrt(k / math.pi)) + 1), last)
    first = within(every, radius)
    if radius == last:
        return reused(ranked(first))
    short = first.where("found < want").select("sample", "src").distinct()
    return reused(ranked(first.where("found >= want")).unionByName(ranked(within(every.join(short, ["sample", "src"], "left_semi"), last))))


def adjacency(spots: DataFrame) -> DataFrame:
    """sample, i, j: each pair of spots that touch (eight neighbours) once, i being the smaller spot_id."""
    steps = spots.sparkSession.createDataFrame([(0, 1), (1, -1), (1, 0), (1, 1)], "dx int, dy int")
    a = spots.select("sample", F.col("spot_id").alias("a"), "x_id", "y_id").join(F.broadcast(steps))
    a = a.select("sample", "a", (F.col("x_id") + F.col("dx")).alias("x_id"), (F.col("y_id") + F.col("dy")).alias("y_id"))
    b = spots.select("sample", F.col("spot_id").alias("b"), "x_id", "y_id")
    return a.join(b, ["sample", "x_id", "y_id"]).select("sample", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))


def neighbour_total(layer: DataFrame, knn: DataFrame, how: str = "mean", value: str = "value") -> DataFrame:
    """Mean or sum of a layer over each spot's neighbours; absent values count as 0, and zeros stay implicit."""
    near = knn.select("sample", "src", F.col("dst").alias("spot_id"), "k").join(layer, ["sample", "spot_id"])
    sums = near.groupBy("sample", "src", "bin_id").agg(F.sum(value).alias(value), F.max("k").alias("k"))
    out = sums.withColumn(value, F.col(value) / F.col("k") if how == "mean" else F.col(value))
    return out.select("sample", F.col("src").alias("spot_id"), "bin_id", value)


def densify(layer: DataFrame, spots: DataFrame, bins: DataFrame, value: str = "value") -> DataFrame:
    """Every present spot by every bin, zeros spelled out: for medians, to which zeros matter. bins has bin_id, and sample if
    they differ by sample."""
    present = spots.where("total_frags > 0").select("sample", "spot_id")
    cells = present.join(bins.select("sample", "bin_id"), "sample") if "sample" in bins.columns else present.join(F.broadcast(bins.select("bin_id")))  # a genome
    return cells.join(layer, ["sample", "spot_id", "bin_id"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def knn_vectors(points: DataFrame, k: int, *, key: str = "id", vector: str = "v", by: str | None = None, block: int = 2048) -> DataFrame:
    """src, dst, dist2, rank of the k nearest vectors (itself among them; ties by id), in the same ``by`` if there is one.

    Blocks of points meet blocks of points: each task holds two blocks, and only k candidates of a point leave it.
    """
    group = [by] if by else []
    kind = [f"`{by}` {points.schema[by].dataType.simpleString()}"] if by else []
    most = points.groupBy(*group).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    n_blocks = max(1, -(-most // block))
    rows = points.select(*group, F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    both = rows.select(*group, "id", "v", F.col("b").alias("p"), other.alias("q"), F.lit(True).alias("asks")).unionByName(rows.select(*group, "id", "v", other.alias("p"), F.col("b").alias("q"), F.lit(False).alias("asks")))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["asks"]], pdf[~pdf["asks"]].sort_values("id")
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in (*group, "src", "dst", "dist2")})
        x, y, ids, m = np.stack(a["v"].to_list()), np.stack(b["v"].to_list()), b["id"].to_numpy(), min(k, len(b))
        dist = np.stack([((y - row) ** 2).sum(axis=1) for row in x])
        top = np.argsort(dist, axis=1, kind="stable")[:, :m]  # b is in the order of ids, so ties are too
        out = pd.DataFrame({"src": np.repeat(a["id"].to_numpy(), m), "dst": ids[top].ravel(), "dist2": np.take_along_axis(dist, top, axis=1).ravel()})
        return out.assign(**{g: pdf[g].iloc[0] for g in group})[[*group, "src", "dst", "dist2"]]

    found = both.groupBy(*group, "p", "q").applyInPandas(nearest, ", ".join([*kind, "src long, dst long, dist2 double"]))
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*group, "src").orderBy("dist2", "dst"))).where(F.col("rank") <= k)
