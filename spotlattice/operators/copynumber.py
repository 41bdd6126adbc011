"""Smoothing along the genome, log2 ratios, copy number and burden."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotlattice.functions.exprs import clip, log2_floor, ratio
from spotlattice.functions.genome import is_autosome
from spotlattice.functions.reuse import reused
from spotlattice.operators.neighbors import densify, knn_xy, neighbour_total
from spotlattice.operators.normalize import bin_key, bin_reference, library_scaled, qc_bins, reference_spots


def genome_smooth(layer: DataFrame, bins: DataFrame, win: int = 3) -> DataFrame:
    """Median filter along each chromosome's kept bins, the edge value repeated; chromosomes of fewer bins stay as they are."""
    if win % 2 == 0:
        raise ValueError("the window must be odd")
    df = layer.join(bins.select(*bin_key(bins), "chr"), bin_key(bins))
    line = W.partitionBy("sample", "spot_id", "chr")
    ordered, whole = line.orderBy("bin_id"), line.orderBy("bin_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    half = win // 2
    first, last = F.first("value").over(whole), F.last("value").over(whole)
    around = [F.coalesce(F.lag("value", i).over(ordered), first) for i in range(half, 0, -1)] + [F.col("value")] + [F.coalesce(F.lead("value", i).over(ordered), last) for i in range(1, half + 1)]
    middle = F.element_at(F.array_sort(F.array(*around)), half + 1)
    out = df.withColumn("out", F.when(F.count("*").over(line) >= win, middle).otherwise(F.col("value")))
    return out.select("sample", "spot_id", "bin_id", F.col("out").alias("value"))


def log2_centered(relative: DataFrame) -> DataFrame:
    """log2 of the relative layer (0 where it is null), minus the spot's median."""
    logged = reused(relative.withColumn("value", F.coalesce(log2_floor(F.col("value")), F.lit(0.0))))
    middle = logged.groupBy("sample", "spot_id").agg(F.median("value").alias("m"))
    return logged.join(middle, ["sample", "spot_id"]).select("sample", "spot_id", "bin_id", (F.col("value") - F.col("m")).alias("value"))


def depth_residualized(layer: DataFrame, spots: DataFrame) -> DataFrame:
    """The layer without each bin's slope on the centred log10 coverage of the spots."""
    cov = spots.where("total_frags > 0").select("sample", "spot_id", F.log10(F.col("total_frags") + 1.0).alias("c"))
    cov = cov.withColumn("c", F.col("c") - F.avg("c").over(W.partitionBy("sample")))
    df = reused(layer.join(cov, ["sample", "spot_id"]))
    slopes = df.groupBy("sample", "bin_id").agg(ratio(F.sum(F.col("value") * F.col("c")), F.sum(F.col("c") * F.col("c"))).alias("beta"))
    return df.join(slopes, ["sample", "bin_id"]).select("sample", "spot_id", "bin_id", (F.col("value") - F.coalesce("beta", F.lit(0.0)) * F.col("c")).alias("value"))


def log2_ratio(relative: DataFrame, spots: DataFrame, bins: DataFrame, *, genome_win: int = 3, regress_depth: bool = True) -> DataFrame:
    """The log2_ratio layer: centred, without depth, smoothed, clipped to [-2, 2]."""
    out = log2_centered(relative)
    if regress_depth:
        out = depth_residualized(out, spots)
    return genome_smooth(out, qc_bins(bins), genome_win).withColumn("value", clip(F.col("value"), -2.0, 2.0))


def copy_number(layer: DataFrame, spots: DataFrame, bins: DataFrame, *, k_spatial: int = 49, genome_win: int = 3, mask: DataFrame | None = None, extent: int = 50) -> DataFrame:
    """The copy_number layer of QC bins and present spots: sums over neighbours, scaled, over the pseudo-normal, the
    autosomal median set to 2, smoothed and clipped to [0, 6]."""
    present, kept = spots.where("total_frags > 0"), qc_bins(bins)
    inside = layer.join(kept.select(*bin_key(kept)), bin_key(kept), "left_semi")
    dense = reused(densify(neighbour_total(inside, knn_xy(present, k_spatial, extent), "sum"), present, kept))
    scaled = reused(library_scaled(dense, dense))
    rel = scaled.join(bin_reference(scaled, reference_spots(spots, mask)), ["sample", "bin_id"]).withColumn("value", ratio(F.col("value"), F.col("ref")))
    rel = reused(rel.join(kept, bin_key(kept)))
    base = rel.groupBy("sample", "spot_id").agg(F.median(F.when(is_autosome(F.col("chr")), F.col("value"))).alias("base"))
    base = base.withColumn("base", F.when(F.col("base") > 0, F.col("base")))
    cn = rel.join(base, ["sample", "spot_id"]).select("sample", "spot_id", "bin_id", F.coalesce(ratio(F.col("value"), F.col("base")) * 2.0, F.lit(2.0)).alias("value"))
    return genome_smooth(cn, kept, genome_win).withColumn("value", clip(F.col("value"), 0.0, 6.0))


def cnv_burden(cn: DataFrame, thresh: float = 0.5) -> DataFrame:
    """Share of a spot's QC bins whose copy number is off 2 by more than thresh."""
    return cn.groupBy("sample", "spot_id").agg(F.avg(F.when(F.abs(F.col("value") - 2.0) > thresh, 1.0).otherwise(0.0)).alias("cnv_burden"))
