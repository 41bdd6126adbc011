"""Every operator of the engine as a query over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.functions.genome import build_bins
from spotlattice.operators import barcodes, clones, cohort, copynumber, frames, multimodal, neighbors, normalize, qc, reads, rigor, segments
from spotlattice.plans.surrogate import BIN, DNA, GRID, Surrogate
from spotlattice.sources import tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
N_BINS = 316


def query(f: Callable[[Surrogate], DataFrame]) -> Callable[[Surrogate], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Surrogate(spark, sf_dir))
    return f


def rounded(df: DataFrame, places: int = 6, *names: str) -> DataFrame:
    """Doubles to a number of places (without a negative zero)."""
    doubles = names or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in doubles})


# ---- the count matrix and its quality -------------------------------------------------------------------------------
@query
def genome_bins(s: Surrogate) -> DataFrame:
    return build_bins(s.spark, 1_000_000)


@query
def counts_per_spot_bin(s: Surrogate) -> DataFrame:
    return s.counts.select("spot_id", "bin_id", "n")


@query
def fragments_in_grid(s: Surrogate) -> DataFrame:
    from spotlattice.sources.fragments import place_fragments

    df = place_fragments(s.fragments, s.matched, bin_size=BIN, grid=GRID)
    return df.groupBy("x_id").agg(F.count("*").alias("n_fragments"), F.countDistinct("spot_id").alias("n_spots"), F.countDistinct("bin_id").alias("n_bins"))


@query
def spot_totals(s: Surrogate) -> DataFrame:
    return qc.spot_totals(s.counts).select("spot_id", "total_frags")


@query
def empty_spot_filter(s: Surrogate) -> DataFrame:
    every = s.matched.where("full_status = 'mapped'").select(((F.col("x_id") - 1) * GRID + F.col("y_id") - 1).alias("spot_id"))
    few = s.counts.where("n > 3")
    totals = every.join(qc.spot_totals(few), "spot_id", "left").withColumn("total_frags", F.coalesce("total_frags", F.lit(0)))
    return qc.drop_empty(totals).select("spot_id", "total_frags")


@query
def bin_qc_flags(s: Surrogate) -> DataFrame:
    return rounded(s.qc_bins.select("bin_id", "bin_mean", "pass_qc"))


@query
def quantile_groups(s: Surrogate) -> DataFrame:
    return qc.quantile_groups(s.bins, "gc", 20)


@query
def gc_corrected(s: Surrogate) -> DataFrame:
    layer = s.counts.select("sample", "spot_id", "bin_id", F.col("n").cast("double").alias("value"))
    return rounded(qc.quantile_correct(layer, s.bins, "gc").select("spot_id", "bin_id", "value"))


@query
def gc_map_corrected(s: Surrogate) -> DataFrame:
    return rounded(s.corrected.select("spot_id", "bin_id", "value"))


def _intervals(s: Surrogate) -> DataFrame:
    return s.table("orders").selectExpr("concat('chr', o_custkey % 22 + 1) as chr", "(o_orderkey * 104729) % 40000000 as start", "(o_orderkey * 104729) % 40000000 + (o_custkey * 7919) % 25000000 as end")


@query
def interval_coverage_fraction(s: Surrogate) -> DataFrame:
    return rounded(tracks.interval_fraction(_intervals(s), s.bins, BIN))


@query
def gc_lookup_left_join(s: Surrogate) -> DataFrame:
    gc = s.bins.where("bin_id % 3 <> 0").select("chr", "start", "gc")
    return rounded(tracks.gc_lookup(s.bins, gc, BIN).select("bin_id", "gc"))


# ---- neighbours and normalisation -----------------------------------------------------------------------------------
@query
def knn_xy(s: Surrogate) -> DataFrame:
    return s.knn10.select("src", "dst", F.col("dist2").cast("long").alias("dist2"), F.col("rank").cast("int").alias("rank"))


@query
def spatial_densify(s: Surrogate) -> DataFrame:
    return rounded(neighbors.neighbour_total(s.corrected, neighbors.knn_xy(s.spots, 49, GRID)).select("spot_id", "bin_id", "value"))


@query
def normalized_relative(s: Surrogate) -> DataFrame:
    return rounded(s.relative.select("spot_id", "bin_id", "value"), 5)


@query
def pseudobulk_log2_sd(s: Surrogate) -> DataFrame:
    return rounded(normalize.pseudobulk_log2_sd(s.relative).select("sd"), 5)


def _mask(s: Surrogate) -> DataFrame:
    return s.spots.where("x_id <= 4").select("sample", "spot_id")


@query
def normal_anchor_guard(s: Surrogate) -> DataFrame:
    _, info = normalize.normal_anchor(s.corrected, s.spots, s.qc_bins, _mask(s), extent=GRID)
    return rounded(info.drop("sample"), 5)


@query
def pick_normal_spots(s: Surrogate) -> DataFrame:
    return normalize.pick_normal_spots(s.burden, min_frags=100).select("spot_id")


# ---- copy number -----------------------------------------------------------------------------------------------------
@query
def log2_centered(s: Surrogate) -> DataFrame:
    return rounded(copynumber.log2_centered(s.relative).select("spot_id", "bin_id", "value"), 5)


@query
def depth_residualized(s: Surrogate) -> DataFrame:
    return rounded(copynumber.depth_residualized(copynumber.log2_centered(s.relative), s.spots).select("spot_id", "bin_id", "value"), 5)


@query
def genome_median_smooth(s: Surrogate) -> DataFrame:
    return rounded(s.log2.select("spot_id", "bin_id", "value"), 5)


@query
def copy_number(s: Surrogate) -> DataFrame:
    return rounded(s.cn.select("spot_id", "bin_id", "value"), 5)


@query
def copy_number_burden(s: Surrogate) -> DataFrame:
    return rounded(copynumber.cnv_burden(s.cn).select("spot_id", "cnv_burden"))


# ---- guards, clones, segments ----------------------------------------------------------------------------------------
@query
def adjacency_edges(s: Surrogate) -> DataFrame:
    return neighbors.adjacency(s.spots).select("i", "j")


@query
def morans_i(s: Surrogate) -> DataFrame:
    return rounded(rigor.morans_i(s.spots, "total_frags").select("i"))


@query
def heterogeneity_verdict(s: Surrogate) -> DataFrame:
    return rounded(rigor.spatial_heterogeneity(s.burden).drop("sample"))


@query
def channel_stripes(s: Surrogate) -> DataFrame:
    return rounded(rigor.channel_stripes(s.spots, "total_frags").drop("sample"))


@query
def region_significance_closed_form(s: Surrogate) -> DataFrame:
    normal = s.clone_labels.where("cluster = 0").select("sample", "spot_id")
    return rounded(rigor.region_significance(s.counts, s.spots, s.bins, ["chr8", "chr17", "chr8:40-100"], extent=GRID, normal=normal).drop("sample"), 5)


def _profiles(s: Surrogate) -> tuple[DataFrame, DataFrame]:
    return clones.clone_profiles(s.log2, s.clone_labels, N_BINS)


@query
def clone_names(s: Surrogate) -> DataFrame:
    return rounded(_profiles(s)[0].drop("sample"), 5)


@query
def clone_profiles(s: Surrogate) -> DataFrame:
    return rounded(_profiles(s)[1].drop("sample"), 5)


@query
def clone_diagnostics(s: Surrogate) -> DataFrame:
    # The index of the given labels, over the log2 ratios, is the only one.
    v = s.log2.groupBy("sample", "spot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin_id", "value"))), lambda c: c["value"]).alias("v"))
    ch = clones.calinski_harabasz(v.join(s.clone_labels.select("sample", "spot_id", "cluster"), ["sample", "spot_id"]), "cluster")
    chosen = ch.select(F.col("k").cast("int").alias("k"), F.array(F.struct(F.col("k").cast("int").alias("k"), "ch")).alias("ch_scores")).join(s.spots.select("sample").distinct())
    return rounded(clones.clone_diagnostics(_profiles(s)[1], N_BINS, chosen, distinct_thresh=0.02).drop("sample"))


@query
def best_split_per_chrom(s: Surrogate) -> DataFrame:
    return rounded(segments.best_splits(s.profile, s.bins).select("chr", "k", "gain"))


@query
def segments_called(s: Surrogate) -> DataFrame:
    return rounded(segments.segment(s.profile, s.bins).drop("sample"))


def _given_segments(s: Surrogate) -> DataFrame:
    """Segments of three bins each, with raw means: given ones, so that the fit alone is compared."""
    seg = s.profile.selectExpr("sample", "cast(bin_id div 3 as int) as segment", "value").groupBy("sample", "segment")
    return seg.agg(F.count("*").alias("n_bins"), (F.avg("value") * 1.0 + F.when(F.col("segment") % 7 == 0, 0.5).otherwise(0.0)).alias("mean"))


@query
def integer_cn_grid(s: Surrogate) -> DataFrame:
    return rounded(segments.integer_cn(_given_segments(s))[1].drop("sample"), 4)


@query
def integer_cn_segments(s: Surrogate) -> DataFrame:
    return segments.integer_cn(_given_segments(s), purity=0.8)[0].select("segment", "integer_cn")


@query
def variance_decomposition(s: Surrogate) -> DataFrame:
    return rounded(multimodal.variance_decomposition(*s.expression, k_density=10, extent=GRID).drop("sample"))


@query
def plot_top_variance_genes(s: Surrogate) -> DataFrame:
    vd = multimodal.variance_decomposition(*s.expression, k_density=10, extent=GRID)
    return rounded(frames.top_variance_genes(vd, 5).select("gene", "explained"))


@query
def plot_grid_clones(s: Surrogate) -> DataFrame:
    return frames.spatial_clones(s.clone_labels.withColumn("clone", F.concat(F.lit("c"), "cluster"))).select("x_id", "y_id", "clone")


@query
def plot_chromosome_cn(s: Surrogate) -> DataFrame:
    return rounded(frames.spatial_copy_number(s.cn, s.spots, s.bins, "chr8").select("x_id", "y_id", "value"), 5)


# ---- cohort ----------------------------------------------------------------------------------------------------------
def _cohort(s: Surrogate) -> DataFrame:
    layer, spots = s.cohort
    return cohort.bulk_profiles(layer, spots, s.bins)


@query
def cohort_profiles(s: Surrogate) -> DataFrame:
    return rounded(_cohort(s).select("sample", "bin_id", "log2"))


@query
def cohort_correlation(s: Surrogate) -> DataFrame:
    return rounded(cohort.correlations(_cohort(s)))


@query
def cohort_correlation_with_chrx(s: Surrogate) -> DataFrame:
    return rounded(cohort.correlations(_cohort(s), autosomes_only=False))


@query
def cohort_sex(s: Surrogate) -> DataFrame:
    return rounded(cohort.inferred_sex(_cohort(s)))


@query
def cohort_recurrence(s: Surrogate) -> DataFrame:
    return rounded(cohort.recurrence(_cohort(s)).select("bin_id", "n_gain", "n_loss", "mean_log2"))


@query
def cohort_loci(s: Surrogate) -> DataFrame:
    return rounded(cohort.recurrent_loci(_cohort(s)), 3)


# ---- barcodes and reads ----------------------------------------------------------------------------------------------
@query
def barcode_match(s: Surrogate) -> DataFrame:
    halves = s.observed.select(F.upper(F.substring("barcode", 9, 8)).alias("half")).distinct()
    return barcodes.match_halves(halves, s.y_refs, "half")


@query
def barcode_match_two(s: Surrogate) -> DataFrame:
    halves = s.observed.select(F.upper(F.substring("barcode", 1, 8)).alias("half")).distinct()
    return barcodes.match_halves(halves, s.x_refs, "half", max_mm=2)


@query
def barcode_status(s: Surrogate) -> DataFrame:
    return s.matches.groupBy("full_status").agg(F.count("*").alias("n_barcodes"), F.sum("fragments").alias("fragments"))


@query
def matched_barcodes(s: Surrogate) -> DataFrame:
    return s.matches.select("barcode_obs", "fragments", "x_status", "y_status", "full_status", "barcode_mapped", "X_ref_index", "Y_ref_index", "x_id", "y_id")


@query
def axis_marginals(s: Surrogate) -> DataFrame:
    return barcodes.fixed_marginals(s.matches, s.x_axis, "x")


@query
def all_marginals(s: Surrogate) -> DataFrame:
    return barcodes.axis_marginals(s.matches, "y").select("y_barcode", "Y_ref_index", "fragments", "y_id")


@query
def spot_matrix_pivot(s: Surrogate) -> DataFrame:
    wide = barcodes.spot_matrix(barcodes.cropped_spots(s.matches))
    return wide.select("x_id", *[F.col(str(i)).cast("long").alias(f"y{i}") for i in range(1, 51)])


@query
def mapping_summary(s: Surrogate) -> DataFrame:
    return rounded(barcodes.mapping_summary(s.observed, s.matches, barcodes.cropped_spots(s.matches)))


@query
def fragment_semi_filter(s: Surrogate) -> DataFrame:
    inside = s.matches.where("full_status = 'mapped' and x_id is not null and y_id is not null")
    lines = s.observed.selectExpr("concat_ws('\t', 'chr1', '5', '9', barcode, '60') as value").unionByName(s.observed.selectExpr("concat_ws('\t', 'chr1', barcode) as value"))
    return barcodes.selected_fragments(lines, inside)


@query
def barcode_extract(s: Surrogate) -> DataFrame:
    return reads.extract_barcodes(s.pairs).select("ord", "drop_reason", F.when(F.col("drop_reason").isNull(), F.col("barcode")).alias("barcode"), F.when(F.col("drop_reason").isNull(), F.length("g_seq")).alias("g_len"))


@query
def barcode_extract_anchored(s: Surrogate) -> DataFrame:
    return reads.extract_barcodes(s.pairs, anchor=True).select("ord", "drop_reason", F.when(F.col("drop_reason").isNull(), F.col("barcode")).alias("barcode"), F.when(F.col("drop_reason").isNull(), F.length("g_seq")).alias("g_len"))


@query
def linker_find(s: Surrogate) -> DataFrame:
    return s.pairs.select("ord", reads.find_linker(F.col("s1")).alias("pos"), reads.linker_within(F.col("s1")).alias("passes"))


@query
def barcode_counts_topk(s: Surrogate) -> DataFrame:
    return reads.barcode_counts(reads.extract_barcodes(s.pairs, anchor=True), 20)


@query
def drop_stats(s: Surrogate) -> DataFrame:
    return reads.drop_stats(reads.extract_barcodes(s.pairs, anchor=True))


@query
def read_names(s: Surrogate) -> DataFrame:
    return reads.fastq_lines(reads.extract_barcodes(s.pairs, anchor=True)).select("r1", "r2")


@query
def cb_regex_counts(s: Surrogate) -> DataFrame:
    return reads.cb_counts(reads.proper_q30(s.sam))


@query
def fragment_projection(s: Surrogate) -> DataFrame:
    return reads.fragments_of(reads.proper_q30(s.sam))


@query
def fragment_length_hist(s: Surrogate) -> DataFrame:
    return reads.length_histogram(s.sam).select("length", "count")


def _aligned(s: Surrogate) -> DataFrame:
    return s.sam.selectExpr("chr", "pos - 1 as start", "pos + 49 as end", "if(flag in (99, 147), '+', '-') as strand")


@query
def cut_sites(s: Surrogate) -> DataFrame:
    return reads.cut_sites(_aligned(s))


@query
def tss_bed(s: Surrogate) -> DataFrame:
    return reads.transcription_starts(s.gtf)


@query
def tss_profile(s: Surrogate) -> DataFrame:
    return reads.tss_profile(reads.transcription_starts(s.gtf), reads.cut_sites(_aligned(s)))


@query
def tss_enrichment(s: Surrogate) -> DataFrame:
    return rounded(reads.tss_enrichment(reads.tss_profile(reads.transcription_starts(s.gtf), reads.cut_sites(_aligned(s)))))


@query
def frip(s: Surrogate) -> DataFrame:
    return rounded(reads.frip(_aligned(s).select("chr", "start", "end"), s.peaks))


@query
def bin_gc_from_sequence(s: Surrogate) -> DataFrame:
    seq = s.table("orders").selectExpr("concat('chr', o_custkey % 22 + 1) as chr", "o_orderkey % 9 as bin", f"concat({DNA.format('o_orderkey')}, if(o_orderkey % 2 = 0, 'NNnnacgt', 'GG')) as seq")
    return rounded(tracks.gc_of_sequence(seq))


# ---- vectors ---------------------------------------------------------------------------------------------------------
def _vectors(s: Surrogate) -> DataFrame:
    return s.table("embeddings").selectExpr("vec_id as id", "transform(embedding, x -> cast(x as double)) as v", "label")


@query
def calinski_harabasz(s: Surrogate) -> DataFrame:
    return rounded(clones.calinski_harabasz(_vectors(s)).select("k", "n", "ch"), 4)


@query
def knn_vectors(s: Surrogate) -> DataFrame:
    return rounded(neighbors.knn_vectors(_vectors(s), 5).select("src", "dst", F.col("rank").cast("int").alias("rank"), "dist2"), 5)


@query
def pc_double_smooth(s: Surrogate) -> DataFrame:
    """All vectors, whole, on a grid of fifty columns that has a place for each."""
    points = s.table("embeddings").selectExpr("'e' as sample", "cast(vec_id as int) as spot_id", "cast(vec_id div 50 + 1 as int) as x_id", "cast(vec_id % 50 + 1 as int) as y_id", "transform(embedding, x -> cast(x as double)) as pcs")
    out = clones.double_smooth(points.select("sample", "spot_id", "pcs"), points, k_pc=6, k_join=5, extent=50)
    return rounded(out.select("spot_id", F.posexplode("pcs").alias("i", "value")), 5)


@query
def adjusted_rand_index(s: Surrogate) -> DataFrame:
    pairs = s.table("orders").selectExpr("o_orderstatus as a", "if(o_orderkey % 3 = 0, o_orderstatus, o_orderpriority) as b")
    return rounded(clones.adjusted_rand_index(pairs, "a", "b"))


# ---- rows only: random or iterative ----------------------------------------------------------------------------------
@query
def pca_scores(s: Surrogate) -> DataFrame:
    return rounded(clones.pca_scores(s.log2).select("spot_id", F.posexplode("pcs").alias("i", "value")), 4)


@query
def kmeans_clones(s: Surrogate) -> DataFrame:
    """Clusters of the smoothed components, as call_clones chooses them."""
    return clones.choose_k(s.smoothed.smoothed)[0].select("spot_id", "cluster")


@query
def dual_smooth_depth_confound(s: Surrogate) -> DataFrame:
    return rounded(s.smoothed.summary.select("n_pcs", "depth_confound_r_pc1"), 4)


@query
def called_clones(s: Surrogate) -> DataFrame:
    """The whole chain: smoothing, clustering, names and profiles; every spot with its clone."""
    return clones.call_clones(s.smoothed, s.spots, N_BINS).labels.select("spot_id", "cluster", "clone")


@query
def permutation_null_mc(s: Surrogate) -> DataFrame:
    return rigor.permutation_significance(s.counts, s.spots, s.bins, ["chr8", "chr17", "chr18"], extent=GRID).select("region", "spot_id", "z")


@query
def morans_i_permutation_p(s: Surrogate) -> DataFrame:
    return rounded(rigor.morans_i_permutation(s.spots, "total_frags").select("i", "p"))


@query
def simulated_counts(s: Surrogate) -> DataFrame:
    from spotlattice.sources.simulate import simulate

    return simulate(s.spark, grid=10, bin_size=BIN, coverage=2.0, seed=0).counts.select("spot_id", "bin_id", "n")
