"""Synthetic sections with planted clones, and the matched expression. Spots are drawn in parallel, each from its own seed,
so the result does not depend on partitions. ``events`` may be given, so that a genuine all-diploid section can be made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.dataset import SpatialDataset
from spotlattice.functions.genome import build_bins
from spotlattice.functions.reuse import reused
from spotlattice.operators.neighbors import knn_xy

# Planted events of each clone as (chromosome, first Mb, last Mb, copies).
CLONE_EVENTS = {
    "Clone1": [("chr9", 0, 40, 1), ("chr17", 0, 25, 1), ("chr8", 100, 146, 3)],
    "Clone2": [("chr18", 0, 60, 1), ("chr8", 100, 146, 4), ("chr12", 0, 40, 3)],
    "Clone3": [("chr9", 0, 40, 1), ("chr18", 0, 60, 1), ("chr20", 0, 64, 3)],
}
DISC = 0.32


def _layout(x: np.ndarray, y: np.ndarray, grid: int, n_clones: int) -> np.ndarray:
    """Wedges of a central disc are clones, the rest is Normal."""
    dx, dy = x - (grid + 1) / 2, y - (grid + 1) / 2
    wedge = np.minimum(((np.arctan2(dy, dx) + np.pi) * n_clones / (2 * np.pi)).astype(int), max(n_clones - 1, 0))
    inside = (dx * dx + dy * dy < (DISC * grid) ** 2) & (n_clones > 0)
    return np.where(inside, np.char.add("Clone", (wedge + 1).astype(str)), "Normal")


def simulate(spark: SparkSession, *, grid: int = 50, bin_size: int = 1_000_000, genome: str = "hg38", coverage: float = 0.4, n_clones: int = 2, seed: int = 0, sample: str = "sim", events: dict[str, list[tuple]] | None = None) -> SpatialDataset:
    """Counts drawn from copies times GC efficiency times mappability; spots have ``true_clone``, empty ones are dropped.

    The tracks of the bins (a few thousand rows) are drawn on the driver; a section's counts on the executors.
    """
    events = CLONE_EVENTS if events is None else events
    bins = build_bins(spark, bin_size, genome).orderBy("bin_id").toPandas()
    rng, n = np.random.default_rng(seed), len(bins)
    bins["gc"] = rng.normal(0.45, 0.06, n).clip(0.25, 0.65)
    bins["mappability"] = rng.beta(8, 1.2, n).clip(0.3, 1.0)
    bins["blacklist"] = np.where(rng.random(n) < 0.03, rng.uniform(0.3, 1.0, n), 0.0)
    usable = np.exp(-((bins["gc"] - 0.45) ** 2) / 0.0128) * bins["mappability"] * (bins["blacklist"] < 0.3)
    rates = {}
    for clone in ["Normal", *(f"Clone{i}" for i in range(1, n_clones + 1))]:
        copies = np.full(n, 2.0)
        for chrom, lo, hi, value in events.get(clone, []):
            copies[(bins["chr"] == chrom) & bins["start"].between(lo * 1e6, hi * 1e6, inclusive="left")] = value
        weight = copies * usable
        rates[clone] = (weight / weight.sum()).to_numpy()
    depth = max(coverage * n, 50.0) / 4.0

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = (b["id"] // grid + 1).to_numpy(), (b["id"] % grid + 1).to_numpy()
            for spot, sx, sy, clone in zip(b["id"], x, y, _layout(x, y, grid, n_clones), strict=True):
                r = np.random.default_rng([seed, int(spot)])
                drawn = r.poisson(r.gamma(4.0, depth) * rates[str(clone)])
                hit = np.flatnonzero(drawn)
                yield pd.DataFrame({"sample": sample, "spot_id": int(spot), "x_id": int(sx), "y_id": int(sy), "true_clone": str(clone), "bin_id": hit, "n": drawn[hit]})

    cells = reused(spark.range(grid * grid).mapInPandas(draw, "sample string, spot_id int, x_id int, y_id int, true_clone string, bin_id int, n long"))
    spots = cells.groupBy("sample", "spot_id", "x_id", "y_id", "true_clone").agg(F.sum("n").alias("total_frags"))
    meta = {"sample": sample, "grid": str(grid), "bin_size": str(bin_size), "genome": genome, "seed": str(seed)}
    return SpatialDataset(spots, spark.createDataFrame(bins), cells.select("sample", "spot_id", "bin_id", "n"), meta=meta)


def simulate_rna(dna: SpatialDataset, *, n_genes: int = 200, frac_genetic: float = 0.3, frac_microenv: float = 0.3, seed: int = 1, clone: str = "true_clone") -> tuple[DataFrame, DataFrame, DataFrame]:
    """expr(spot_id, gene, value), cells(spot_id, x_id, y_id, cell_type) and genes(gene, true_driver).

    Tumour cells fill the disc, immune cells the ring around it. Genes follow the clone, the tumour density, or nothing.
    """
    grid = int(dna.meta["grid"])
    centre, disc = (grid + 1) / 2, DISC * grid
    r = F.hypot(F.col("x_id") - centre, F.col("y_id") - centre)
    cells = dna.spots.select("spot_id", "x_id", "y_id", F.when(r < disc, "Tumor").when(r < disc + 4, "Immune").otherwise("Normal").alias("cell_type"))
    tumour = cells.select(F.col("spot_id").alias("dst"), (F.col("cell_type") == "Tumor").cast("double").alias("t"))
    near = knn_xy(dna.spots, 50, grid).join(tumour, "dst").groupBy(F.col("src").alias("spot_id")).agg(F.avg("t").alias("t"))
    scale = near.agg(F.avg("t").alias("m"), F.stddev_pop("t").alias("s"))
    density = near.join(F.broadcast(scale)).select("spot_id", ((F.col("t") - F.col("m")) / (F.col("s") + 1e-9)).alias("density"))
    rng = np.random.default_rng(seed)
    kinds = ["genetic"] * int(n_genes * frac_genetic) + ["microenv"] * int(n_genes * frac_microenv)
    kinds = rng.permutation(kinds + ["noise"] * (n_genes - len(kinds)))
    table = [(f"gene_{i}", str(k), float(rng.normal(5.0, 0.5)), float(rng.uniform(2, 4))) for i, k in enumerate(kinds)]
    genes = dna.spots.sparkSession.createDataFrame(table, "gene string, true_driver string, base double, slope double")
    standard = lambda *parts: F.sqrt(-2.0 * F.log(_unit(1, *parts))) * F.cos(F.lit(2 * np.pi) * _unit(2, *parts))

    def _unit(i: int, *parts):
        """A number in (0, 1) from a hash of the parts."""
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    rows = dna.spots.select("spot_id", F.col(clone).alias("clone")).join(density, "spot_id").join(F.broadcast(genes))
    shift = F.when(F.col("true_driver") == "genetic", 2.0 * standard("gene", "clone")).when(F.col("true_driver") == "microenv", F.col("slope") * F.col("density")).otherwise(0.0)
    expr = rows.select("spot_id", "gene", (F.col("base") + shift + standard("gene", "spot_id")).alias("value"))
    return expr, cells, genes.select("gene", "true_driver")
