"""Normalisation against a pseudo-normal, and what is read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlattice.functions.exprs import log2_floor, ratio
from spotlattice.functions.reuse import reused
from spotlattice.operators.neighbors import densify, knn_xy, neighbour_total

MIN_REFERENCE = 20


def qc_bins(bins: DataFrame) -> DataFrame:
    """bin_id and chr, with sample if bins have one, of the bins that pass; all bins if there is no pass_qc."""
    out = bins.where("pass_qc") if "pass_qc" in bins.columns else bins
    return out.select(*bin_key(bins), "chr")


def bin_key(bins: DataFrame) -> list[str]:
    """What a layer joins bins by: those without a sample hold for all."""
    return ["sample", "bin_id"] if "sample" in bins.columns else ["bin_id"]


def reference_spots(spots: DataFrame, mask: DataFrame | None) -> DataFrame:
    """Present spots in the mask (sample, spot_id) if there are enough of them in a sample, else all present ones."""
    present = spots.where("total_frags > 0").select("sample", "spot_id")
    if mask is None:
        return present
    masked = present.join(mask.select("sample", "spot_id").distinct(), ["sample", "spot_id"], "left_semi")
    enough = masked.groupBy("sample").agg(F.count("*").alias("c")).where(F.col("c") >= MIN_REFERENCE).select("sample")
    return masked.join(enough, "sample", "left_semi").unionByName(present.join(enough, "sample", "left_anti"))


def library_scaled(layer: DataFrame, total_over: DataFrame) -> DataFrame:
    """Values over their spot's total in ``total_over``, times the median total of the sample's spots."""
    totals = total_over.groupBy("sample", "spot_id").agg(F.sum("value").alias("t"))
    middle = totals.groupBy("sample").agg(F.median("t").alias("m"))
    scaled = layer.join(totals, ["sample", "spot_id"]).join(middle, "sample")
    return scaled.select("sample", "spot_id", "bin_id", (ratio(F.col("value"), F.col("t")) * F.col("m")).alias("value"))


def bin_reference(layer: DataFrame, ref: DataFrame) -> DataFrame:
    """Median of each bin over the reference spots; null where it is not positive."""
    med = layer.join(ref, ["sample", "spot_id"], "left_semi").groupBy("sample", "bin_id").agg(F.median("value").alias("ref"))
    return med.withColumn("ref", F.when(F.col("ref") > 0, F.col("ref")))


def normalize(layer: DataFrame, spots: DataFrame, bins: DataFrame, *, mask: DataFrame | None = None, spatial_k: int = 49, extent: int = 50) -> DataFrame:
    """The relative layer, for QC bins of present spots: means over neighbours, library-scaled, over the pseudo-normal."""
    present = spots.where("total_frags > 0")
    if spatial_k and spatial_k > 1:
        layer = reused(neighbour_total(layer, knn_xy(present, spatial_k, extent), "mean"))
    dense = densify(layer, present, qc_bins(bins))
    scaled = reused(library_scaled(dense, layer))
    rel = scaled.join(bin_reference(scaled, reference_spots(spots, mask)), ["sample", "bin_id"])
    return rel.select("sample", "spot_id", "bin_id", ratio(F.col("value"), F.col("ref")).alias("value"))


def pseudobulk_log2_sd(relative: DataFrame) -> DataFrame:
    """sample, sd: population deviation over bins of the median log2 of each bin."""
    per_bin = relative.groupBy("sample", "bin_id").agg(F.median(log2_floor(F.col("value"))).alias("pb"))
    return per_bin.groupBy("sample").agg(F.stddev_pop("pb").alias("sd"))


def normal_anchor(layer: DataFrame, spots: DataFrame, bins: DataFrame, mask: DataFrame, *, collapse_frac: float = 0.4, spatial_k: int = 49, extent: int = 50) -> tuple[DataFrame, DataFrame]:
    """The layer anchored to the mask's spots, and sample, n_reference_spots, bulk_sd_before, bulk_sd_after, signal_collapsed."""
    before = pseudobulk_log2_sd(normalize(layer, spots, bins, spatial_k=spatial_k, extent=extent)).withColumnRenamed("sd", "bulk_sd_before")
    anchored = normalize(layer, spots, bins, mask=mask, spatial_k=spatial_k, extent=extent)
    after = pseudobulk_log2_sd(anchored).withColumnRenamed("sd", "bulk_sd_after")
    used = spots.where("total_frags > 0").join(mask.select("sample", "spot_id").distinct(), ["sample", "spot_id"], "left_semi").groupBy("sample").agg(F.count("*").alias("n_reference_spots"))
    both = before.join(after, "sample").join(used, "sample", "left").withColumn("n_reference_spots", F.coalesce("n_reference_spots", F.lit(0)))
    collapsed = F.coalesce((F.col("bulk_sd_before") > 0) & (F.col("bulk_sd_after") < F.lit(collapse_frac) * F.col("bulk_sd_before")), F.lit(False))
    return anchored, both.withColumn("signal_collapsed", collapsed)


def pick_normal_spots(spots: DataFrame, *, quantile: float = 0.30, min_frags: int = 200, burden: str = "cnv_burden") -> DataFrame:
    """sample, spot_id of the flattest spots. With fewer than 20 of min_frags, those above the 80th percentile of fragments."""
    if burden not in spots.columns:
        raise KeyError(f"{burden!r} is missing: call copy_number first")
    finite = F.col(burden).isNotNull() & ~F.isnan(burden)
    counted = spots.groupBy("sample").agg(F.sum((finite & (F.col("total_frags") >= min_frags)).cast("int")).alias("c"), F.percentile("total_frags", 0.8).alias("p80"))
    least = F.when(F.col("c") < MIN_REFERENCE, F.col("p80")).otherwise(F.lit(float(min_frags)))
    able = spots.join(counted, "sample").where(finite & (F.col("total_frags") >= least))
    cut = able.groupBy("sample").agg(F.percentile(burden, quantile).alias("cut"))
    return able.join(cut, "sample").where(F.col(burden) <= F.col("cut")).select("sample", "spot_id")
