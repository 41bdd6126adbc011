"""Guards against artifacts: spatial autocorrelation, banding, and regional significance."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotlattice.functions.exprs import ratio
from spotlattice.operators.neighbors import adjacency, knn_xy

MIN_VALUES, MIN_EDGES = 20, 10


def _finite(spots: DataFrame, key: str) -> DataFrame:
    v = F.col(key).cast("double")
    return spots.where(v.isNotNull() & ~F.isnan(v)).withColumn("v", v)


def _moran(z: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """by, i: Moran's I of z(by, spot_id, z) over edges(sample, i, j); null if it is not defined."""
    a, b = z.select(*by, F.col("spot_id").alias("i"), F.col("z").alias("zi")), z.select(*by, F.col("spot_id").alias("j"), F.col("z").alias("zj"))
    on = ["sample"]
    pairs = edges.join(a, [*on, "i"]).join(b, [*by, "j"])
    across = pairs.groupBy(*by).agg(F.count("*").alias("m"), F.sum(F.col("zi") * F.col("zj")).alias("s"))
    own = z.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("q"))
    ok = (F.col("n") >= MIN_VALUES) & (F.coalesce("m", F.lit(0)) >= MIN_EDGES) & (F.col("q") > 0)
    return own.join(across, by, "left").select(*by, F.when(ok, ratio(F.col("n"), F.col("m")) * ratio(F.col("s"), F.col("q"))).alias("i"))


def morans_i(spots: DataFrame, key: str) -> DataFrame:
    """sample, i over the eight neighbours of the spots whose value is finite."""
    df = _finite(spots, key)
    z = df.withColumn("z", F.col("v") - F.avg("v").over(W.partitionBy("sample"))).select("sample", "spot_id", "z")
    return _moran(z, adjacency(df), ["sample"])


def morans_i_permutation(spots: DataFrame, key: str, *, n_perm: int = 999, seed: int = 0) -> DataFrame:
    """sample, i, p: the share of seeded random relabellings, with this one, whose I is at least as large."""
    df = _finite(spots, key)
    z = df.withColumn("z", F.col("v") - F.avg("v").over(W.partitionBy("sample"))).select("sample", "spot_id", "z")
    here = _moran(z, adjacency(df), ["sample"])
    perms = z.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
    w = W.partitionBy("sample", "perm")
    places = perms.select("sample", "perm", "spot_id", F.row_number().over(w.orderBy("spot_id")).alias("r"))
    values = perms.select("sample", "perm", "z", F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), F.col("spot_id").cast("string")).cast("binary")), "spot_id")).alias("r"))
    null = _moran(places.join(values, ["sample", "perm", "r"]).select("sample", "perm", "spot_id", "z"), adjacency(df), ["sample", "perm"])
    above = null.select("sample", F.col("i").alias("ip")).join(here, "sample").groupBy("sample").agg(F.sum((F.col("ip") >= F.col("i")).cast("int")).alias("c"))
    return here.join(above, "sample", "left").select("sample", "i", F.when(F.col("i").isNotNull(), (F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n_perm + 1))).alias("p"))


def spatial_heterogeneity(spots: DataFrame, *, burden: str = "cnv_burden", coverage: str = "total_frags") -> DataFrame:
    """sample, moran_coverage, moran_cnv_burden, cna_exceeds_coverage. Give an unsmoothed burden for a strict answer."""
    if burden not in spots.columns:
        raise KeyError(f"{burden!r} is missing: call copy_number first")
    cov, bur = morans_i(spots, coverage).withColumnRenamed("i", "moran_coverage"), morans_i(spots, burden).withColumnRenamed("i", "moran_cnv_burden")
    both = cov.join(bur, "sample")
    return both.withColumn("cna_exceeds_coverage", F.coalesce(F.col("moran_cnv_burden") > F.col("moran_coverage"), F.lit(False)))


def channel_stripes(spots: DataFrame, key: str, ratio_over: float = 3.0) -> DataFrame:
    """sample, row_dominance, col_dominance, stripe_artifact: the variance that row or column means explain."""
    df = _finite(spots, key)
    rows, cols, every = W.partitionBy("sample", "x_id"), W.partitionBy("sample", "y_id"), W.partitionBy("sample")
    df = df.withColumns({"r": F.col("v") - F.avg("v").over(rows), "c": F.col("v") - F.avg("v").over(cols), "m": F.avg("v").over(every)})
    var = df.groupBy("sample").agg(F.var_pop("v").alias("t"), F.var_pop("r").alias("vr"), F.var_pop("c").alias("vc"))
    part = lambda c: F.when(F.col("t") == 0, F.lit(0.0)).otherwise((F.col("t") - F.col(c)) / F.greatest("t", F.lit(1e-12)))
    out = var.select("sample", "t", part("vr").alias("row_dominance"), part("vc").alias("col_dominance"))
    more = lambda a, b: F.col(a) / F.greatest(b, F.lit(1e-6)) > ratio_over
    stripe = (F.col("t") > 0) & (F.greatest("row_dominance", "col_dominance") > 0.5) & (more("row_dominance", "col_dominance") | more("col_dominance", "row_dominance"))
    return out.select("sample", "row_dominance", "col_dominance", stripe.alias("stripe_artifact"))


def _regional(counts: DataFrame, spots: DataFrame, bins: DataFrame, regions: list[str], k_xy: int, extent: int) -> tuple[DataFrame, DataFrame]:
    """observed sums over neighbours (sample, region, spot_id, obs, p) with p their share of all fragments, and totals."""
    from spotlattice.functions.exprs import in_region

    present = spots.where("total_frags > 0")
    picked = None
    for region in regions:
        part = bins.where(in_region(region)).select(F.lit(region).alias("region"), "bin_id")
        picked = part if picked is None else picked.unionByName(part)
    each = counts.join(F.broadcast(picked), "bin_id").groupBy("sample", "region", "spot_id").agg(F.sum("n").alias("c"))
    totals = each.groupBy("sample", "region").agg(F.sum("c").alias("total"))
    cells = totals.select("sample", "region").join(present.select("sample", "spot_id", "total_frags"), "sample").join(each, ["sample", "region", "spot_id"], "left")
    share = cells.withColumn("p", F.col("total_frags") / F.sum("total_frags").over(W.partitionBy("sample", "region")))
    knn = knn_xy(present, k_xy, extent).select("sample", "src", F.col("dst").alias("spot_id"))
    sums = knn.join(share, ["sample", "spot_id"]).groupBy("sample", "region", "src").agg(F.sum(F.coalesce("c", F.lit(0))).alias("obs"), F.sum("p").alias("p"))
    return sums.withColumnRenamed("src", "spot_id"), totals


def region_significance(counts: DataFrame, spots: DataFrame, bins: DataFrame, regions: list[str], *, k_xy: int = 10, extent: int = 50, normal: DataFrame | None = None) -> DataFrame:
    """sample, region, spot_id, z, in closed form: under the multinomial null the sum over a neighbourhood is binomial.

    ``normal`` (sample, spot_id) names the spots whose mean z is taken off. Regions without fragments are left out.
    """
    sums, totals = _regional(counts, spots, bins, regions, k_xy, extent)
    m = F.col("total")
    z = (F.col("obs") - m * F.col("p")) / (F.sqrt(F.greatest(m * F.col("p") * (1.0 - F.col("p")), F.lit(0.0))) + F.lit(1e-9))
    out = sums.join(totals, ["sample", "region"]).select("sample", "region", "spot_id", z.alias("z"))
    return out if normal is None else _less_normal(out, normal)


def _less_normal(out: DataFrame, normal: DataFrame) -> DataFrame:
    means = out.join(normal.select("sample", "spot_id"), ["sample", "spot_id"], "left_semi").groupBy("sample", "region").agg(F.avg("z").alias("m"))
    return out.join(means, ["sample", "region"], "left").select("sample", "region", "spot_id", (F.col("z") - F.coalesce("m", F.lit(0.0))).alias("z"))


def permutation_significance(counts: DataFrame, spots: DataFrame, bins: DataFrame, regions: list[str], *, n_perm: int = 100, k_xy: int = 10, seed: int = 0, extent: int = 50, normal: DataFrame | None = None) -> DataFrame:
    """The same by drawing: each task makes some of the multinomial draws of a region and returns sums, not draws."""
    present = spots.where("total_frags > 0")
    sums, totals = _regional(counts, spots, bins, regions, k_xy, extent)
    knn = knn_xy(present, k_xy, extent).select("sample", "src", "dst")
    near = knn.groupBy("sample", "src").agg(F.sort_array(F.collect_list("dst")).alias("near")).withColumnRenamed("src", "spot_id")
    rows = totals.join(present, "sample").join(near, ["sample", "spot_id"]).select("sample", "region", "total", "spot_id", "total_frags", "near", F.explode(F.sequence(F.lit(0), F.lit(max(0, (n_perm - 1) // 25)))).alias("chunk"))

    def draws(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("spot_id")
        chunk, at = int(pdf["chunk"].iloc[0]), {s: i for i, s in enumerate(pdf["spot_id"])}
        rng = np.random.default_rng([seed, chunk, *(zlib.crc32(pdf[c].iloc[0].encode()) for c in ("sample", "region"))])
        p = pdf["total_frags"].to_numpy(float)
        got = rng.multinomial(int(pdf["total"].iloc[0]), p / p.sum(), size=min(25, n_perm - 25 * chunk)).astype(float)
        smooth = np.stack([got[:, [at[x] for x in ks]].sum(axis=1) for ks in pdf["near"]], 1)
        return pd.DataFrame({"sample": pdf["sample"], "region": pdf["region"], "spot_id": pdf["spot_id"], "s": smooth.sum(axis=0), "q": (smooth**2).sum(axis=0), "k": float(len(got))})

    made = rows.groupBy("sample", "region", "chunk").applyInPandas(draws, "sample string, region string, spot_id int, s double, q double, k double")
    null = made.groupBy("sample", "region", "spot_id").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("k").alias("k"))
    mean = F.col("s") / F.col("k")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("k") - mean * mean, F.lit(0.0)))
    out = sums.join(null, ["sample", "region", "spot_id"]).select("sample", "region", "spot_id", ((F.col("obs") - mean) / (sd + F.lit(1e-9))).alias("z"))
    return out if normal is None else _less_normal(out, normal)
