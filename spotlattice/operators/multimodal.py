"""DNA and RNA of the same spots: variance of each gene's expression by clone and by microenvironment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotlattice.functions.exprs import ratio
from spotlattice.functions.reuse import reused
from spotlattice.operators.neighbors import knn_xy

MIN_SHARED = 20


def _keyed(df: DataFrame) -> DataFrame:
    """df with a sample column: one sample of its own if there is none."""
    return df if "sample" in df.columns else df.withColumn("sample", F.lit("rna"))


def align_spots(clones: DataFrame, cells: DataFrame) -> DataFrame:
    """cells(sample, spot_id, x_id, y_id, cell_type) with the clone at the same place of the same sample; of several there
    the largest spot_id counts."""
    dna = _keyed(clones).groupBy("sample", "x_id", "y_id").agg(F.max_by("clone", "spot_id").alias("clone"))
    return _keyed(cells).join(dna, ["sample", "x_id", "y_id"])


def densities(shared: DataFrame, tumor: tuple[str, ...], immune: tuple[str, ...], k: int = 50, extent: int = 50) -> DataFrame:
    """sample, spot_id, clone, td, imd: shares of tumour and immune cells among the k nearest shared spots, centred."""
    kind = shared.select("sample", F.col("spot_id").alias("dst"), F.col("cell_type").isin(*tumor).cast("double").alias("t"), F.col("cell_type").isin(*immune).cast("double").alias("m"))
    near = reused(knn_xy(shared, k, extent).join(kind, ["sample", "dst"]).groupBy("sample", F.col("src").alias("spot_id")).agg(F.avg("t").alias("t"), F.avg("m").alias("m")))
    mean = near.groupBy("sample").agg(F.avg("t").alias("mt"), F.avg("m").alias("mm"))
    near = near.join(mean, "sample").select("sample", "spot_id", (F.col("t") - F.col("mt")).alias("td"), (F.col("m") - F.col("mm")).alias("imd"))
    return shared.select("sample", "spot_id", "clone").join(near, ["sample", "spot_id"])


def _explained(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """sample, gene, ss: what the two centred regressors a and b explain of y, by their normal equations; if they are
    collinear or constant, by the larger one alone."""
    s = {k: F.sum(F.col(p) * F.col(q)) for k, p, q in (("aa", a, a), ("bb", b, b), ("ab", a, b), ("ay", a, y), ("by", b, y))}
    g = df.groupBy("sample", "gene").agg(*[v.alias(k) for k, v in s.items()])
    aa, bb, ab, ay, by = (F.col(k) for k in ("aa", "bb", "ab", "ay", "by"))
    det = aa * bb - ab * ab
    both = (ay * ay * bb - 2 * ay * by * ab + by * by * aa) / F.nullif(det, F.lit(0.0))
    single = F.when(aa >= bb, ratio(ay * ay, aa)).otherwise(ratio(by * by, bb))
    return g.select("sample", "gene", F.coalesce(F.when(det > 1e-12 * F.greatest(aa * bb, F.lit(1e-300)), both), single, F.lit(0.0)).alias("ss"))


def variance_decomposition(expr: DataFrame, clones: DataFrame, cells: DataFrame, *, tumor: tuple[str, ...] = ("Tumor",), immune: tuple[str, ...] = ("Immune",), k_density: int = 50, extent: int = 50) -> DataFrame:
    """expr(sample, spot_id, gene, value) -> sample, gene, vd_genetic, vd_microenv, vd_residual, vd_dominant.

    Least squares of value on clone and the two densities, in each sample. Centring within clones takes the clones out
    (Frisch, Waugh and Lovell), so each fit is a two by two system over sums of one pass; no matrix is built. Frames
    without a sample column are one sample. A sample with too few shared spots is an error.
    """
    shared = reused(align_spots(clones, cells))
    few = shared.groupBy("sample").agg(F.count("*").alias("c")).agg(F.min("c")).first()[0] or 0
    if few < MIN_SHARED:
        raise ValueError(f"fewer than {MIN_SHARED} spots are shared by the assays")
    df = _keyed(expr).join(densities(shared, tumor, immune, k_density, extent), ["sample", "spot_id"])
    key = ["sample", "gene"]
    all_of, clone_of = W.partitionBy(*key), W.partitionBy(*key, "clone")
    centred = {}
    for name in ("value", "td", "imd"):
        centred[f"{name}_g"] = F.col(name) - F.avg(name).over(all_of)
        centred[f"{name}_c"] = F.col(name) - F.avg(name).over(clone_of)
    df = df.withColumns(centred)
    total = df.groupBy(*key).agg(F.sum(F.col("value_g") * F.col("value_g")).alias("tss"), F.sum(F.col("value_c") * F.col("value_c")).alias("rss_clone"))
    no_clone = _explained(df, "value_g", "td_g", "imd_g").withColumnRenamed("ss", "by_density")
    full = _explained(df, "value_c", "td_c", "imd_c").withColumnRenamed("ss", "by_density_in_clone")
    out = total.join(no_clone, key).join(full, key).withColumn("rss", F.col("rss_clone") - F.col("by_density_in_clone"))
    genetic = F.greatest(F.col("tss") - F.col("by_density") - F.col("rss"), F.lit(0.0))
    micro = F.greatest(F.col("by_density_in_clone"), F.lit(0.0))
    tss = F.when(F.col("tss") > 0, F.col("tss"))
    out = out.select(*key, (genetic / tss).alias("vd_genetic"), (micro / tss).alias("vd_microenv"), (F.col("rss") / tss).alias("vd_residual"))
    return out.withColumn("vd_dominant", F.when(F.col("vd_genetic") >= F.col("vd_microenv"), "genetic").otherwise("microenv"))


def decomposition_summary(vd: DataFrame) -> DataFrame:
    """Means of the fractions and counts of the genes that each factor dominates, for each sample."""
    more = lambda a, b: F.coalesce(F.sum((F.col(a) > F.col(b)).cast("int")), F.lit(0))
    return vd.groupBy("sample").agg(F.avg("vd_genetic").alias("mean_frac_genetic"), F.avg("vd_microenv").alias("mean_frac_microenv"), F.avg("vd_residual").alias("mean_frac_residual"), more("vd_genetic", "vd_microenv").alias("n_genes_genetic_dominant"), more("vd_microenv", "vd_genetic").alias("n_genes_microenv_dominant"))
