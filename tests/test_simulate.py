"""Planted truth: the whole chain finds the clones of a synthetic section, and the decomposition finds the drivers."""

import numpy as np
from pyspark.sql import functions as F

from spotlattice.operators import clones, copynumber, multimodal, normalize, qc, rigor
from spotlattice.sources.simulate import simulate, simulate_rna


def test_planted_clones_and_drivers(spark):
    grid = 16
    data = simulate(spark, grid=grid, bin_size=10_000_000, coverage=8.0, n_clones=1, seed=0)
    spots, bins = data.spots.cache(), data.bins
    assert data.counts.groupBy().sum("n").first()[0] == spots.groupBy().sum("total_frags").first()[0]
    qcd = qc.bin_qc(data.counts, spots, bins)
    layer = qc.correct_bias(data.counts, bins)
    cn = copynumber.copy_number(layer, spots, qcd, k_spatial=9, extent=grid)
    by = cn.join(bins.where("chr = 'chr8' and start >= 100000000"), "bin_id").join(spots, ["sample", "spot_id"]).groupBy("true_clone").agg(F.avg("value").alias("m"))
    got = {r["true_clone"]: r["m"] for r in by.collect()}
    assert got["Clone1"] > got["Normal"] + 0.3
    rel = normalize.normalize(layer, spots, qcd, spatial_k=9, extent=grid)
    smooth = clones.dual_smooth(rel, spots, qcd, n_pcs=4, k_pc=9, k_xy=9, k_join=5, extent=grid)
    confound = smooth.summary.first()
    assert confound["n_pcs"] == 4 and abs(confound["depth_confound_r_pc1"]) < 0.4
    called = clones.call_clones(smooth, spots, bins.count(), kmax=3, tries=3)
    ari = clones.adjusted_rand_index(called.labels.join(spots, ["sample", "spot_id"]), "clone", "true_clone").first()["ari"]
    assert called.summary.first()["k"] == 2 and ari > 0.7
    names = {r["clone"]: r["n_spots"] for r in called.names.collect()}
    assert names.keys() == {"Normal", "Clone1"} and sum(names.values()) == spots.count() and names["Normal"] > names["Clone1"]
    assert called.profiles.where("clone = 'Normal' and abs(cna) > 1e-9").isEmpty()
    # coverage of a section is not autocorrelated, and a section without events has a flat profile
    assert abs(rigor.morans_i(spots, "total_frags").first()["i"]) < 0.2
    expr, cells, genes = simulate_rna(data, n_genes=40, seed=1)
    vd = multimodal.variance_decomposition(expr, spots.select("spot_id", "x_id", "y_id", F.col("true_clone").alias("clone")), cells, extent=grid)
    rows = vd.join(genes, "gene").where("true_driver <> 'noise'").collect()
    assert np.mean([r["vd_dominant"] == r["true_driver"] for r in rows]) > 0.6


def test_diploid_section_is_the_same_whatever_the_partitions(spark):
    a = simulate(spark, grid=6, bin_size=10_000_000, events={}, seed=3)
    assert a.spots.select("true_clone").distinct().count() >= 2
    total = a.counts.groupBy().sum("n").first()[0]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert simulate(spark, grid=6, bin_size=10_000_000, events={}, seed=3).counts.groupBy().sum("n").first()[0] == total
    spark.conf.set("spark.sql.shuffle.partitions", "4")
