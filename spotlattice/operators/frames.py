"""Plot-ready tables: what the figures show, without a plotting library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotlattice.operators.barcodes import spot_matrix


def spatial_clones(spots: DataFrame) -> DataFrame:
    return spots.select("sample", "x_id", "y_id", "clone")


def spatial_copy_number(cn: DataFrame, spots: DataFrame, bins: DataFrame, chrom: str) -> DataFrame:
    """x_id, y_id and the mean copy number over a chromosome."""
    inside = cn.join(F.broadcast(bins.where(F.col("chr") == chrom).select("bin_id").distinct()), "bin_id")
    return inside.groupBy("sample", "spot_id").agg(F.avg("value").alias("value")).join(spots, ["sample", "spot_id"]).select("sample", "x_id", "y_id", "value")


def significance(z: DataFrame, spots: DataFrame, region: str) -> DataFrame:
    """x_id, y_id, z of one region; an error if it was not computed."""
    rows = z.where(F.col("region") == region)
    if rows.isEmpty():
        raise ValueError(f"no significance of {region}")
    return rows.join(spots, ["sample", "spot_id"]).select("sample", "x_id", "y_id", "z")


def clone_profile_lines(profiles: DataFrame, bins: DataFrame) -> DataFrame:
    return profiles.join(F.broadcast(bins.select("bin_id", "chr", "start")), "bin_id").select("sample", "clone", "bin_id", "chr", "start", "cna")


def top_variance_genes(vd: DataFrame, n_top: int = 40) -> DataFrame:
    """The genes of each sample with the largest explained share, with both parts stacked."""
    df = vd.withColumn("explained", F.col("vd_genetic") + F.col("vd_microenv"))
    rank = F.row_number().over(W.partitionBy("sample").orderBy(F.col("explained").desc(), "gene"))
    return df.withColumn("rank", rank).where(F.col("rank") <= n_top).drop("rank")


def marginal_bars(marginals: DataFrame, axis: str) -> DataFrame:
    return marginals.select(F.col(f"{axis}_id").alias("position"), "fragments")


def heatmap(cropped: DataFrame, row: str = "x_id", col: str = "y_id") -> DataFrame:
    return spot_matrix(cropped, row, col)


def grid(spots: DataFrame, value: str, side: int = 50) -> DataFrame:
    """A row for each x and columns 1 to side for y; null where there is no spot."""
    wide = spots.groupBy("x_id").pivot("y_id", list(range(1, side + 1))).agg(F.first(value))
    return spots.sparkSession.range(1, side + 1).select(F.col("id").cast("int").alias("x_id")).join(wide, "x_id", "left")
