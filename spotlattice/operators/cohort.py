"""Comparison of samples over the same bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlattice.functions.exprs import log2_floor
from spotlattice.functions.genome import COHORT_LOCI, is_autosome


def bulk_profiles(layer: DataFrame, spots: DataFrame, bins: DataFrame) -> DataFrame:
    """sample, bin_id, chr, start, end, log2: the median over present spots over the sample's autosomal median (that of
    all bins if it is not positive)."""
    present = spots.where("total_frags > 0").select("sample", "spot_id")
    pb = layer.join(present, ["sample", "spot_id"], "left_semi").groupBy("sample", "bin_id").agg(F.median("value").alias("pb"))
    pb = pb.join(F.broadcast(bins.select("bin_id", "chr", "start", "end").distinct()), "bin_id")
    base = pb.groupBy("sample").agg(F.median(F.when(is_autosome(F.col("chr")), F.col("pb"))).alias("auto"), F.median("pb").alias("every"))
    b = F.when(F.col("auto") > 0, F.col("auto")).otherwise(F.col("every"))
    return pb.join(F.broadcast(base), "sample").select("sample", "bin_id", "chr", "start", "end", log2_floor(F.col("pb") / F.nullif(b, F.lit(0.0))).alias("log2"))


def correlations(profiles: DataFrame, autosomes_only: bool = True) -> DataFrame:
    """sample_a, sample_b, r over the bins that both have; null if one does not vary."""
    df = profiles.where(is_autosome(F.col("chr"))) if autosomes_only else profiles
    a, b = df.select("bin_id", F.col("sample").alias("sample_a"), F.col("log2").alias("x")), df.select("bin_id", F.col("sample").alias("sample_b"), F.col("log2").alias("y"))
    pairs = a.join(b, "bin_id").where("x is not null and y is not null")
    dev = F.stddev_pop("x") * F.stddev_pop("y")
    return pairs.groupBy("sample_a", "sample_b").agg((F.covar_pop("x", "y") / F.nullif(dev, F.lit(0.0))).alias("r"))


def inferred_sex(profiles: DataFrame, male_chrx: float = -0.3) -> DataFrame:
    """sample, chrx_mean_log2, sex; a sample without chrX counts as female."""
    x = profiles.groupBy("sample").agg(F.avg(F.when(F.col("chr") == "chrX", F.col("log2"))).alias("chrx_mean_log2"))
    return x.withColumn("sex", F.when(F.col("chrx_mean_log2") < male_chrx, "male").otherwise("female"))


def recurrence(profiles: DataFrame, thresh: float = 0.2) -> DataFrame:
    """bin_id, chr, start, end, n_gain, n_loss, mean_log2."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return profiles.groupBy("bin_id", "chr", "start", "end").agg(count(F.col("log2") > thresh).alias("n_gain"), count(F.col("log2") < -thresh).alias("n_loss"), F.avg("log2").alias("mean_log2"))


def recurrent_loci(profiles: DataFrame, thresh: float = 0.2, loci: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """locus, sample, log2 (3 places), n_gain, n_loss of the first bin that holds each locus."""
    rows = [(k, c, int(mb * 1e6)) for k, (c, mb) in (loci or COHORT_LOCI).items()]
    table = profiles.sparkSession.createDataFrame(rows, "locus string, chr string, pos long")
    hit = recurrence(profiles, thresh).join(F.broadcast(table), "chr").where("start <= pos and pos < end")
    first = hit.groupBy("locus").agg(F.min(F.struct("bin_id", "n_gain", "n_loss")).alias("h"))
    return first.join(profiles, first["h.bin_id"] == profiles["bin_id"]).select("locus", "sample", F.bround("log2", 3).alias("log2"), "h.n_gain", "h.n_loss")


def name_samples(parts: list[DataFrame]) -> list[DataFrame]:
    """A sample column for each table that has none: sample0, sample1, ..."""
    return [p if "sample" in p.columns else p.withColumn("sample", F.lit(f"sample{i}")) for i, p in enumerate(parts)]
