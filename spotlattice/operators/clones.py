"""Clones: principal components, double smoothing, clustering, and their guards.

A section's spots are a few thousand by the physics of the chip, so a section is the unit of work: its matrix is one group,
in one task, and a cohort is as many tasks. What crosses sections is keyed by ``sample`` throughout.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotlattice.functions.exprs import ratio
from spotlattice.functions.reuse import reused
from spotlattice.operators.copynumber import log2_ratio
from spotlattice.operators.neighbors import knn_vectors, knn_xy


def principal_components(x: np.ndarray, n_pcs: int) -> np.ndarray:
    """Scores of the rows of x, columns centred; each component's loading of the largest size is positive."""
    x = x - x.mean(axis=0)
    k = min(n_pcs, x.shape[1], max(len(x) - 1, 1))
    if len(x) <= x.shape[1]:  # by the smaller of the two products
        values, vectors = np.linalg.eigh(x @ x.T)
        scores = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0))
        loadings = x.T @ scores
    else:
        loadings = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :k]
        scores = x @ loadings
    top = loadings[np.abs(loadings).argmax(axis=0), np.arange(k)]
    return scores * np.where(top < 0, -1.0, 1.0)


def pca_scores(log2: DataFrame, n_pcs: int = 15) -> DataFrame:
    """sample, spot_id, pcs of every section, over the bins that any of its spots has; a missing or null value counts 0."""
    rows = log2.groupBy("sample", "spot_id").agg(F.collect_list(F.struct("bin_id", F.coalesce("value", F.lit(0.0)).alias("value"))).alias("c"))
    rows = rows.select("sample", "spot_id", F.transform("c", lambda c: c["bin_id"]).alias("bins"), F.transform("c", lambda c: c["value"]).alias("values"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("spot_id", ignore_index=True)
        bins, at = np.unique(np.concatenate(pdf["bins"].to_list()), return_inverse=True)
        x = np.zeros((len(pdf), len(bins)))
        x[np.repeat(np.arange(len(pdf)), pdf["bins"].map(len)), at] = np.concatenate(pdf["values"].to_list())
        return pdf[["sample", "spot_id"]].assign(pcs=list(principal_components(x, n_pcs)))

    return rows.groupBy("sample").applyInPandas(run, "sample string, spot_id int, pcs array<double>")


def _mean_over(knn: DataFrame, points: DataFrame, key: str, vector: str) -> DataFrame:
    """The element-wise mean of the vectors of each point's neighbours, in its own sample."""
    joined = knn.select("sample", "src", F.col("dst").alias(key)).join(points.select("sample", key, F.posexplode(vector).alias("i", "x")), ["sample", key])
    means = joined.groupBy("sample", "src", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("sample", F.col("src").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias(vector))


def double_smooth(points: DataFrame, spots: DataFrame, *, k_pc: int = 50, k_xy: int = 50, k_join: int = 10, extent: int = 50) -> DataFrame:
    """points(sample, spot_id, pcs) averaged over the k_pc nearest in PC space, then over the min(k_join, k_xy) nearest on
    the grid, both in the same section."""
    once = _mean_over(knn_vectors(points, k_pc, key="spot_id", vector="pcs", by="sample"), points, "spot_id", "pcs")
    return _mean_over(knn_xy(spots, min(k_join, k_xy), extent), once, "spot_id", "pcs")


def depth_confound(points: DataFrame, spots: DataFrame) -> DataFrame:
    """sample, n_pcs, depth_confound_r_pc1: the first component's correlation with the log10 coverage, null if either does
    not vary."""
    df = points.join(spots, ["sample", "spot_id"]).select("sample", F.size("pcs").alias("k"), F.col("pcs")[0].alias("p"), F.log10(F.col("total_frags") + 1.0).alias("c"))
    vary = (F.var_pop("p") > 0) & (F.var_pop("c") > 0)
    return df.groupBy("sample").agg(F.max("k").alias("n_pcs"), F.when(vary, F.covar_pop("p", "c") / F.nullif(F.stddev_pop("p") * F.stddev_pop("c"), F.lit(0.0))).alias("depth_confound_r_pc1"))


class Smoothed(NamedTuple):
    """What dual_smooth finds, as tables keyed by sample."""

    log2: DataFrame  #: sample, spot_id, bin_id, value
    pcs: DataFrame  #: sample, spot_id, pcs
    smoothed: DataFrame  #: the same, smoothed twice
    summary: DataFrame  #: sample, n_pcs, depth_confound_r_pc1


def dual_smooth(relative: DataFrame, spots: DataFrame, bins: DataFrame, *, n_pcs: int = 15, k_pc: int = 50, k_xy: int = 50, k_join: int = 10, genome_win: int = 3, regress_depth: bool = True, extent: int = 50) -> Smoothed:
    """The log2 ratio layer of a relative layer, its principal components, and these smoothed in PC space and on the grid."""
    present = spots.where("total_frags > 0")
    log2 = reused(log2_ratio(relative, spots, bins, genome_win=genome_win, regress_depth=regress_depth))
    pcs = reused(pca_scores(log2, n_pcs))
    smoothed = reused(double_smooth(pcs, present, k_pc=k_pc, k_xy=k_xy, k_join=k_join, extent=extent))
    return Smoothed(log2, pcs, smoothed, depth_confound(pcs, present))


def calinski_harabasz(points: DataFrame, label: str = "label", vector: str = "v") -> DataFrame:
    """k, n, between, within and the index (B / (k - 1)) / (W / (n - k)) of vectors under labels."""
    cells = points.select(F.monotonically_increasing_id().alias("id"), F.col(label).alias("label"), F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    by = cells.groupBy("label", "i").agg(F.count("*").alias("c"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = by.groupBy("i").agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    joined = by.join(F.broadcast(total), "i").withColumn("d", F.col("s") / F.col("c") - F.col("ts") / F.col("tc"))
    out = joined.agg(F.countDistinct("label").alias("k"), F.max("tc").alias("n"), F.sum(F.col("c") * F.col("d") * F.col("d")).alias("between"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("c")).alias("within"))
    return out.withColumn("ch", ratio(ratio(F.col("between"), F.col("k") - 1), ratio(F.col("within"), F.col("n") - F.col("k"))))


def k_means(x: np.ndarray, k: int, tries: int, rng: np.random.Generator, rounds: int = 300) -> np.ndarray:
    """Labels of the best of several runs of Lloyd's algorithm from spread starts; clusters are numbered by first member."""
    best, cost = np.zeros(len(x), int), np.inf
    for _ in range(tries):
        centres = x[[rng.integers(len(x))]]
        for _ in range(k - 1):
            far = ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
            p = far / far.sum() if far.sum() > 0 else None
            centres = np.vstack([centres, x[rng.choice(len(x), p=p)]])
        labels = None
        for _ in range(rounds):
            d = ((x[:, None] - centres) ** 2).sum(axis=2)
            now = d.argmin(axis=1)
            if labels is not None and (now == labels).all():
                break
            labels = now
            for j in np.flatnonzero(np.bincount(labels, minlength=k)):
                centres[j] = x[labels == j].mean(axis=0)
        spent = float(((x - centres[labels]) ** 2).sum())
        if spent < cost - 1e-9:
            best, cost = labels, spent
    return np.unique(best, return_index=True)[1].argsort().argsort()[np.unique(best, return_inverse=True)[1]]


def variance_ratio(x: np.ndarray, labels: np.ndarray) -> float | None:
    """The index of Calinski and Harabasz; None if it is not defined."""
    k, n = len(np.unique(labels)), len(x)
    if not 2 <= k < n:
        return None
    means = np.stack([x[labels == c].mean(axis=0) for c in np.unique(labels)])
    size = np.bincount(labels)[np.unique(labels)]
    between = float((size[:, None] * (means - x.mean(axis=0)) ** 2).sum())
    within = float(((x - means[np.searchsorted(np.unique(labels), labels)]) ** 2).sum())
    return 1.0 if within == 0 else between / (k - 1) / (within / (n - k))


def choose_k(points: DataFrame, *, kmin: int = 2, kmax: int = 8, tries: int = 10, seed: int = 0, vector: str = "pcs") -> tuple[DataFrame, DataFrame]:
    """The clusters of each sample's points at the number of the best index: sample, spot_id, cluster; and sample, k,
    ch_scores (an array of (k, ch) of all that were tried). Without any index two clusters are made."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("spot_id", ignore_index=True)
        x = np.nan_to_num(np.stack(pdf[vector].to_list()).astype(float), posinf=0.0, neginf=0.0)
        best, scores = None, []
        for k in range(kmin, min(kmax, len(x) - 1) + 1):
            labels = k_means(x, k, tries, np.random.default_rng([seed, k]))
            ch = variance_ratio(x, labels)
            if ch is not None:
                scores.append({"k": k, "ch": ch})
                if best is None or ch > best[0]:
                    best = (ch, k, labels)
        if best is None:
            best, scores = (0.0, 2, k_means(x, min(2, len(x)), tries, np.random.default_rng(seed))), [{"k": 2, "ch": 0.0}]
        return pdf[["sample", "spot_id"]].assign(cluster=best[2], k=best[1], ch_scores=[scores] * len(pdf))

    found = reused(points.select("sample", "spot_id", vector).groupBy("sample").applyInPandas(run, "sample string, spot_id int, cluster int, k int, ch_scores array<struct<k:int,ch:double>>"))
    return found.select("sample", "spot_id", "cluster"), found.groupBy("sample").agg(F.first("k").alias("k"), F.first("ch_scores").alias("ch_scores"))


def clone_profiles(log2: DataFrame, labels: DataFrame, n_bins_total: int) -> tuple[DataFrame, DataFrame]:
    """From labels(sample, spot_id, cluster): (sample, cluster, clone, aberration), and profiles (sample, clone, bin_id, cna).

    In each sample the cluster of the lowest median absolute log2 ratio, over all bins (those without a value count 0), is
    Normal; the others are Clone1, Clone2, ... by falling mean absolute aberration. Medians are of values to five places.
    """
    group = ["sample", "cluster"]
    df = reused(log2.join(labels.select("sample", "spot_id", "cluster"), ["sample", "spot_id"]))
    # Each value once with its frequency, and 0 as often as a cell has no row.
    sizes = F.round(F.abs("value"), 5).alias("a")
    every = labels.groupBy(*group).agg((F.count("*") * n_bins_total).alias("cells"))
    have = df.groupBy(*group, sizes).agg(F.count("*").alias("c"))
    zeros = every.join(have.groupBy(*group).agg(F.sum("c").alias("h")), group, "left").select(*group, F.lit(0.0).alias("a"), (F.col("cells") - F.coalesce("h", F.lit(0))).alias("c"))
    flat = have.unionByName(zeros).where("c > 0").groupBy(*group).agg(F.percentile("a", 0.5, F.col("c")).alias("flat"))
    normal = flat.groupBy("sample").agg(F.min(F.struct("flat", "cluster"))["cluster"].alias("normal"))
    means = reused(df.groupBy(*group, "bin_id").agg(F.avg("value").alias("m")))
    base = means.join(normal, "sample").where("cluster = normal").select("sample", "normal", "bin_id", F.col("m").alias("base"))
    diff = reused(means.join(base, ["sample", "bin_id"]).withColumn("d", F.col("m") - F.col("base")))
    middle = diff.groupBy(*group).agg(F.median("d").alias("md"))
    cna = diff.join(middle, group).select(*group, "normal", "bin_id", (F.col("d") - F.col("md")).alias("cna"))
    aber = cna.groupBy(*group, "normal").agg(F.avg(F.abs("cna")).alias("aberration"))
    order = F.row_number().over(W.partitionBy("sample").orderBy((F.col("cluster") == F.col("normal")).desc(), F.col("aberration").desc(), "cluster")) - 1
    names = aber.select(*group, F.when(order == 0, "Normal").otherwise(F.concat(F.lit("Clone"), order)).alias("clone"), "aberration")
    return names, cna.join(names, group).select("sample", "clone", "bin_id", "cna")


class Clones(NamedTuple):
    """What call_clones finds, as tables keyed by sample."""

    labels: DataFrame  #: sample, spot_id, cluster (-1 for spots without fragments), clone ("empty" for those)
    profiles: DataFrame  #: sample, clone, bin_id, cna
    names: DataFrame  #: sample, cluster, clone, aberration, n_spots
    summary: DataFrame  #: sample, k, normal_cluster, ch_scores


def call_clones(found: Smoothed | None, spots: DataFrame, n_bins_total: int, *, kmin: int = 2, kmax: int = 8, tries: int = 10, seed: int = 0) -> Clones:
    """Clones of each section from its smoothed components: clusters, their names and their profiles."""
    if found is None:
        raise ValueError("run dual_smooth first")
    clusters, chosen = choose_k(found.smoothed, kmin=kmin, kmax=kmax, tries=tries, seed=seed)
    names, profiles = clone_profiles(found.log2, clusters, n_bins_total)
    names = reused(names.join(clusters.groupBy("sample", "cluster").agg(F.count("*").alias("n_spots")), ["sample", "cluster"]))
    named = clusters.join(names.select("sample", "cluster", "clone"), ["sample", "cluster"], "left")
    labels = spots.select("sample", "spot_id").join(named, ["sample", "spot_id"], "left")
    clone = F.when(F.col("cluster").isNull(), "empty").otherwise(F.coalesce("clone", F.lit("NA")))
    labels = labels.select("sample", "spot_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), clone.alias("clone"))
    normal = names.where("clone = 'Normal'").select("sample", F.col("cluster").alias("normal_cluster"))
    return Clones(labels, profiles, names, chosen.join(normal, "sample", "left"))


def clone_diagnostics(profiles: DataFrame, n_bins_total: int, chosen: DataFrame, *, distinct_thresh: float = 0.2, distinct_floor: float = 0.05) -> DataFrame:
    """For each sample distinctness over all bins (bins without a profile count as alike), whether k is at the search's
    edge, and the verdict. ``chosen`` is (sample, k, ch_scores)."""
    spread = profiles.groupBy("sample", "bin_id").agg((F.max("cna") - F.min("cna")).alias("s"))
    wide = spread.groupBy("sample").agg(F.sum((F.col("s") > distinct_thresh).cast("int")).alias("c"))
    last = F.array_max("ch_scores")  # by k
    edge = (F.col("k") == last["k"]) & (last["ch"] == F.array_max(F.transform("ch_scores", lambda x: x["ch"])))
    out = chosen.join(wide, "sample", "left").select("sample", (F.coalesce("c", F.lit(0)) / F.lit(float(n_bins_total))).alias("clone_cna_distinctness"), F.col("k").alias("chosen_k"), F.coalesce(edge, F.lit(False)).alias("ch_boundary_k"))
    return out.withColumn("clones_likely_artifact", (F.col("clone_cna_distinctness") < distinct_floor) | F.col("ch_boundary_k"))


def adjusted_rand_index(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """ari of two labellings, from their contingency table."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("c"))
    both = cells.agg(F.sum(two("c")).alias("x"))
    left = cells.groupBy(a).agg(F.sum("c").alias("c")).agg(F.sum(two("c")).alias("l"), F.sum("c").alias("n"))
    right = cells.groupBy(b).agg(F.sum("c").alias("c")).agg(F.sum(two("c")).alias("r"))
    df = both.join(left).join(right).withColumn("e", F.col("l") * F.col("r") / F.nullif(two("n"), F.lit(0.0)))
    return df.select(F.coalesce(ratio(F.col("x") - F.col("e"), (F.col("l") + F.col("r")) / 2.0 - F.col("e")), F.lit(1.0)).alias("ari"))
