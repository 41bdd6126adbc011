"""Segments of a profile, and integer copy numbers of segments."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotlattice.functions.exprs import ratio
from spotlattice.functions.genome import chrom_table


def pseudobulk(layer: DataFrame) -> DataFrame:
    """sample, bin_id, value: the median over spots."""
    return layer.groupBy("sample", "bin_id").agg(F.median("value").alias("value"))


def best_cut(y: np.ndarray, min_size: int) -> tuple[int, float] | None:
    """The first split that lowers the squared error most, and by how much; None if both sides can't have min_size."""
    n = len(y)
    if n < 2 * min_size:
        return None
    left = np.cumsum(y)[min_size - 1 : n - min_size]
    k = np.arange(min_size, n - min_size + 1)
    gain = left**2 / k + (y.sum() - left) ** 2 / (n - k) - y.sum() ** 2 / n
    at = int(gain.argmax())
    return int(k[at]), float(gain[at])


def cut_points(y: np.ndarray, penalty: float, min_size: int) -> list[int]:
    """Split where it pays more than the penalty, and the parts again."""

    def within(lo: int, hi: int) -> list[int]:
        best = best_cut(y[lo:hi], min_size)
        if best is None or best[1] <= penalty:
            return []
        return [*within(lo, lo + best[0]), lo + best[0], *within(lo + best[0], hi)]

    return within(0, len(y))


def noise_penalty(y: np.ndarray, scale: float) -> float:
    """A BIC-like penalty with a robust estimate of the noise from the differences of neighbours."""
    d = np.diff(y)
    sigma = 1.4826 * float(np.median(np.abs(d - np.median(d)))) / math.sqrt(2) if len(d) else 0.0
    return scale * max(sigma, 1e-6) ** 2 * math.log(max(len(y), 2))


def segment(profile: DataFrame, bins: DataFrame, *, penalty_scale: float = 2.0, min_size: int = 3) -> DataFrame:
    """profile(sample, bin_id, value) -> sample, segment, chr, first_bin, last_bin, start, end, n_bins, mean (raw).

    A chromosome of a sample is a group of a few hundred bins; chromosomes with fewer than min_size values have none.
    """
    ord_of = chrom_table(profile.sparkSession).select("chr", "ord")
    rows = profile.where(F.col("value").isNotNull() & ~F.isnan("value")).join(F.broadcast(bins.select("bin_id", "chr", "start", "end").distinct()), "bin_id").join(F.broadcast(ord_of), "chr")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin_id", ignore_index=True)
        y, out = pdf["value"].to_numpy(float), []
        edges = [0, *cut_points(y, noise_penalty(y, penalty_scale), min_size), len(y)] if len(y) >= min_size else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            first, last = pdf.iloc[a], pdf.iloc[b - 1]
            out.append((first["sample"], first["chr"], int(first["ord"]), int(first["bin_id"]), int(last["bin_id"]), int(first["start"]), int(last["end"]), b - a, float(y[a:b].mean())))
        return pd.DataFrame(out, columns=["sample", "chr", "ord", "first_bin", "last_bin", "start", "end", "n_bins", "mean"])

    made = rows.groupBy("sample", "chr").applyInPandas(run, "sample string, chr string, ord int, first_bin int, last_bin int, start long, end long, n_bins int, mean double")
    number = F.row_number().over(W.partitionBy("sample").orderBy("ord", "first_bin")) - 1
    return made.withColumn("segment", number).drop("ord")


def bin_segments(segments: DataFrame, profile: DataFrame) -> DataFrame:
    """sample, bin_id, segment (-1 where there is none) and seg_mean."""
    each = segments.select("sample", "segment", F.col("mean").alias("seg_mean"), "first_bin", "last_bin").withColumn("bin_id", F.explode(F.sequence("first_bin", "last_bin")))
    held = profile.where("value is not null").select("sample", "bin_id")
    kept = each.join(held, ["sample", "bin_id"], "left_semi").select("sample", "bin_id", "segment", "seg_mean")
    return profile.select("sample", "bin_id").join(kept, ["sample", "bin_id"], "left").withColumn("segment", F.coalesce("segment", F.lit(-1)))


def segment_summary(segments: DataFrame, profile: DataFrame, bins: DataFrame) -> DataFrame:
    """sample, n_segments, var_explained (3 places), flat_genome."""
    by_bin = profile.join(bin_segments(segments, profile), ["sample", "bin_id"]).where("value is not null and seg_mean is not null")
    var = by_bin.groupBy("sample").agg(F.var_pop("value").alias("t"), F.var_pop(F.col("value") - F.col("seg_mean")).alias("r"))
    n = segments.groupBy("sample").agg(F.count("*").alias("n_segments"))
    chroms = profile.where("value is not null").join(bins.select("bin_id", "chr").distinct(), "bin_id").groupBy("sample").agg(F.countDistinct("chr").alias("c"))
    out = chroms.join(n, "sample", "left").join(var, "sample", "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))
    explained = F.coalesce(1.0 - ratio(F.col("r"), F.col("t")), F.lit(0.0))
    return out.select("sample", "n_segments", F.bround(explained, 3).alias("var_explained"), (F.col("n_segments") <= F.col("c")).alias("flat_genome"))


def best_splits(profile: DataFrame, bins: DataFrame, min_size: int = 3) -> DataFrame:
    """sample, chr, k, gain: the first best split of each chromosome, with running sums; one level of segment()."""
    df = profile.where("value is not null").join(F.broadcast(bins.select("bin_id", "chr").distinct()), "bin_id")
    line = W.partitionBy("sample", "chr")
    df = df.withColumns({"k": F.row_number().over(line.orderBy("bin_id")), "l": F.sum("value").over(line.orderBy("bin_id").rowsBetween(W.unboundedPreceding, 0)), "n": F.count("*").over(line), "t": F.sum("value").over(line)})
    k, n, left, total = F.col("k"), F.col("n"), F.col("l"), F.col("t")
    df = df.where((k >= min_size) & (k <= n - min_size))
    gain = left * left / k + (total - left) * (total - left) / (n - k) - total * total / n
    return df.withColumn("gain", gain).groupBy("sample", "chr").agg(F.min(F.struct(-F.round("gain", 9), "k", "gain")).alias("b")).select("sample", "chr", "b.k", "b.gain")


def purity_grid(spark, min_purity: float = 0.1, n_grid: int = 181) -> DataFrame:
    step = (1.0 - min_purity) / (n_grid - 1)
    return spark.range(n_grid).select(F.when(F.col("id") == n_grid - 1, F.lit(1.0)).otherwise(F.lit(min_purity) + F.col("id") * F.lit(step)).alias("p"))


def fit_purity(segments: DataFrame, *, baseline: float = 2.0, min_purity: float = 0.1, n_grid: int = 181, event_thresh: float = 0.1) -> DataFrame:
    """sample, has_events, p: the highest purity whose cost is near the least (1.5 times, and 1e-6); 1 without events.

    The cost of a purity is the distance of the segments to the integers, weighed by their bins. Means have 4 places.
    """
    seg = segments.select("sample", "n_bins", (F.bround("mean", 4) - baseline).alias("dev"))
    events = seg.groupBy("sample").agg((F.max(F.abs("dev")) > event_thresh).alias("has_events"))
    cn = F.lit(baseline) + F.col("dev") / F.col("p")
    grid = F.broadcast(purity_grid(segments.sparkSession, min_purity, n_grid))
    cost = seg.join(grid).groupBy("sample", "p").agg(F.sum(F.col("n_bins") * F.pow(cn - F.rint(cn), 2)).alias("cost"))
    near = cost.withColumn("least", F.min("cost").over(W.partitionBy("sample"))).where(F.col("cost") <= F.col("least") * 1.5 + 1e-6)
    return events.join(near.groupBy("sample").agg(F.max("p").alias("p")), "sample").withColumn("p", F.when(F.col("has_events"), F.col("p")).otherwise(1.0))


def integer_cn(segments: DataFrame, *, purity: float | None = None, baseline: float = 2.0, max_cn: int = 8, event_thresh: float = 0.1, **grid) -> tuple[DataFrame, DataFrame]:
    """The segments with cn_continuous and integer_cn; and sample, purity (null if nothing tells), ploidy,
    max_integer_deviation, n_states, resolvable."""
    fitted = fit_purity(segments, baseline=baseline, event_thresh=event_thresh, **grid)
    if purity is not None:
        fitted = fitted.withColumn("p", F.lit(float(purity)))
    df = segments.withColumn("dev", F.bround("mean", 4) - baseline).join(F.broadcast(fitted), "sample").withColumn("c", F.lit(baseline) + F.col("dev") / F.col("p"))
    df = df.withColumn("integer_cn", F.least(F.greatest(F.rint("c"), F.lit(0.0)), F.lit(float(max_cn))).cast("int"))
    off = F.when(F.abs("dev") > event_thresh, F.abs(F.col("c") - F.rint("c")))
    known = F.lit(purity is not None) | F.first("has_events")
    info = df.groupBy("sample").agg(
        F.bround(F.when(known, F.first("p")), 3).alias("purity"),
        F.bround(ratio(F.sum(F.col("n_bins") * F.col("integer_cn")), F.sum("n_bins")), 2).alias("ploidy"),
        F.bround(F.coalesce(F.max(off), F.lit(0.0)), 4).alias("max_integer_deviation"),
        F.countDistinct("integer_cn").alias("n_states"),
        (F.first("has_events") & (F.coalesce(F.max(off), F.lit(0.0)) < 0.15)).alias("resolvable"),
    )
    return df.withColumn("cn_continuous", F.bround("c", 3)).drop("dev", "p", "has_events", "c"), info
