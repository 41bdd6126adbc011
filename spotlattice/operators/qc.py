"""Bin quality and bias correction. Tables are long and zeros are implicit; every table has a ``sample`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotlattice.functions.exprs import ratio
from spotlattice.functions.reuse import reused


def spot_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sample", "spot_id").agg(F.sum("n").alias("total_frags"))


def drop_empty(spots: DataFrame) -> DataFrame:
    return spots.where("total_frags > 0")


def present_count(spots: DataFrame) -> DataFrame:
    return drop_empty(spots).groupBy("sample").agg(F.count("*").alias("n_present"))


def bin_means(counts: DataFrame, spots: DataFrame, bins: DataFrame) -> DataFrame:
    """Mean count of each bin over the spots that have fragments; 0 for bins without any."""
    sums = counts.groupBy("sample", "bin_id").agg(F.sum("n").alias("s"))
    every = present_count(spots).join(F.broadcast(bins))  # a genome's bins, for each sample
    return every.join(sums, ["sample", "bin_id"], "left").withColumn("bin_mean", F.coalesce(F.col("s"), F.lit(0)) / F.col("n_present")).drop("s", "n_present")


def bin_qc(counts: DataFrame, spots: DataFrame, bins: DataFrame, *, gc_min: float = 0.35, map_min: float = 0.5, blacklist_max: float = 0.3, min_bin_frac: float = 0.2) -> DataFrame:
    """bins of each sample with bin_mean and pass_qc. Bounds are strict; a covariate that bins lack is not tested."""
    means = reused(bin_means(counts, spots, bins))
    middle = means.where("bin_mean > 0").groupBy("sample").agg(F.median("bin_mean").alias("m"))
    ok = F.col("bin_mean") > F.lit(min_bin_frac) * F.coalesce("m", F.lit(0.0))
    for name, test in (("gc", F.col("gc") > gc_min), ("mappability", F.col("mappability") > map_min), ("blacklist", F.col("blacklist") < blacklist_max)):
        if name in bins.columns:
            ok = ok & F.coalesce(test, F.lit(False))
    return means.join(middle, "sample", "left").withColumn("pass_qc", ok).drop("m")


def quantile_groups(bins: DataFrame, covariate: str, n_quantiles: int = 20) -> DataFrame:
    """bin_id, grp: groups of equal size by rank of the covariate; ties in order of bin_id."""
    n = F.count("*").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(covariate, "bin_id")) - 1
    ranked = bins.select("bin_id", covariate).withColumns({"n": n, "r": rank})
    return ranked.select("bin_id", F.least(F.expr(f"(r * {n_quantiles}) div n"), F.lit(n_quantiles - 1)).cast("int").alias("grp"))


def quantile_correct(layer: DataFrame, bins: DataFrame, covariate: str, n_quantiles: int = 20, value: str = "value") -> DataFrame:
    """Each value over its spot's mean in the covariate group of its bin, times the spot's mean over all bins.

    Zeros stay zeros, so the sparse table is enough: sums need no zeros, and the sizes of the groups come from the bins.
    """
    groups = quantile_groups(bins, covariate, n_quantiles)
    groups = groups.withColumns({"in_grp": F.count("*").over(W.partitionBy("grp")), "n_bins": F.count("*").over(W.partitionBy())})
    df = layer.join(F.broadcast(groups), "bin_id")
    spot = W.partitionBy("sample", "spot_id")
    df = df.withColumns({"g_sum": F.sum(value).over(W.partitionBy("sample", "spot_id", "grp")), "s_sum": F.sum(value).over(spot)})
    expected, mean = F.col("g_sum") / F.col("in_grp"), F.col("s_sum") / F.col("n_bins")
    out = F.when(expected > 0, ratio(F.col(value), expected) * mean).otherwise(0.0)
    return df.select("sample", "spot_id", "bin_id", out.alias(value))


def correct_bias(counts: DataFrame, bins: DataFrame, n_quantiles: int = 20) -> DataFrame:
    """The corrected layer: by GC, then by mappability, as far as the bins have them."""
    out = counts.select("sample", "spot_id", "bin_id", F.col("n").cast("double").alias("value"))
    for covariate in ("gc", "mappability"):
        if covariate in bins.columns:
            out = quantile_correct(out, bins, covariate, n_quantiles)
    return out
