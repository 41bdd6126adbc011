"""Small oracles in numpy, planted truths, and properties of the engine's operators."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlattice.dataset import SpatialDataset
from spotlattice.functions.exprs import clip, device_order, half_even, hamming, parse_index_ranges, parse_region
from spotlattice.functions.genome import build_bins, n_bins
from spotlattice.operators import barcodes, clones, copynumber, multimodal, neighbors, qc, reads, rigor, segments
from spotlattice.sources.fragments import from_matrix, from_pipeline
from spotlattice.sources.sequences import register
from spotlattice.sources.tracks import interval_fraction


def grid(spark, side=5, value=lambda x, y: 1, hole=()):
    rows = [("s", (x - 1) * side + y - 1, x, y, 10, float(value(x, y))) for x in range(1, side + 1) for y in range(1, side + 1) if (x, y) not in hole]
    return spark.createDataFrame(rows, "sample string, spot_id int, x_id int, y_id int, total_frags long, v double")


def test_bins(spark):
    assert build_bins(spark, 1_000_000).count() == n_bins() == 3044
    last = build_bins(spark, 10_000_000).where("chr = 'chrX'").orderBy(F.desc("start")).first()
    assert (last["start"], last["end"]) == (150_000_000, 156_040_895)


def test_scalars(spark):
    row = spark.range(1).select(hamming(F.lit("ACGT"), F.lit("AGGA")).alias("h"), hamming(F.lit("A"), F.lit("AC")).alias("n"), half_even(F.lit(2.5)).alias("r"), clip(F.lit(None).cast("double"), 0.0, 1.0).alias("c")).first()
    assert (row["h"], row["n"], row["r"], row["c"]) == (2, None, 2.0, None)
    assert parse_index_ranges("3-5,9") == [3, 4, 5, 9]
    assert parse_region("chr8:120-145") == ("chr8", 120_000_000, 145_000_000)
    with pytest.raises(ValueError):
        parse_index_ranges("5-3")
    with pytest.raises(ValueError):
        parse_index_ranges("1-3,2")


def test_device_order_is_a_bijection():
    order = device_order()
    assert sorted(order) == sorted(order.values()) == list(range(1, 51))
    assert [order[i] for i in (1, 47, 5, 43, 26)] == [1, 5, 9, 13, 48]


def test_fragments_to_matrix(spark, tmp_path):
    f = spark.createDataFrame([("chr1", 5, 15, "aa", 60), ("chr1", 999_990, 1_000_020, "AA", 60), ("chr1", 5, 9, "NA", 60), ("chr9", 1, 3, "BB", 1), ("chrM", 1, 3, "AA", 1)], "chr string, start long, end long, cb string, mapq int")
    m = spark.createDataFrame([("AA", "mapped", 1, 1, 0), ("AA", "mapped", 2, 2, 1), ("BB", "mapped", 51, 1, 2)], "barcode_obs string, full_status string, x_id int, y_id int, ord int")
    data = from_pipeline(f, m, grid=50)
    assert [(r["spot_id"], r["bin_id"], r["n"]) for r in data.counts.orderBy("bin_id").collect()] == [(51, 0, 1), (51, 1, 1)]
    assert data.spots.first()["total_frags"] == 2
    data.with_layer("corrected", data.counts).save(str(tmp_path / "d"))
    again = SpatialDataset.load(spark, str(tmp_path / "d"))
    assert again.layers["corrected"].count() == 2 and again.meta["grid"] == "50"


def test_from_matrix_keeps_empty_spots(spark):
    data = from_matrix(spark, [[1, 0], [0, 0], [2, 3], [0, 1]], spark.range(2).selectExpr("cast(id as int) as bin_id"))
    assert [r["total_frags"] for r in data.spots.orderBy("spot_id").collect()] == [1, 0, 5, 1]


def test_quantile_correction_against_numpy(spark):
    rng = np.random.default_rng(0)
    c, gc = rng.poisson(2.0, (6, 12)), rng.random(12)
    bins = spark.createDataFrame([(i, float(g)) for i, g in enumerate(gc)], "bin_id int, gc double")
    layer = spark.createDataFrame([("s", i, j, float(c[i, j])) for i in range(6) for j in range(12) if c[i, j]], "sample string, spot_id int, bin_id int, value double")
    group = np.minimum(gc.argsort().argsort() * 4 // 12, 3)
    want = np.zeros(c.shape)
    for i, j in product(range(6), range(12)):
        e = c[i, group == group[j]].mean()
        want[i, j] = c[i, j] / e * c[i].mean() if e > 0 else 0
    got = np.zeros(c.shape)
    for r in qc.quantile_correct(layer, bins, "gc", 4).collect():
        got[r["spot_id"], r["bin_id"]] = r["value"]
    np.testing.assert_allclose(got, want, rtol=1e-12)


@pytest.mark.parametrize("k", [1, 5, 12])
def test_knn_against_brute_force(spark, k):
    spots = grid(spark, 6, hole={(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)})
    at = {r["spot_id"]: (r["x_id"], r["y_id"]) for r in spots.collect()}
    got: dict = {}
    for r in neighbors.knn_xy(spots, k, 6).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    for s, (x, y) in at.items():
        assert got[s] == sorted(at, key=lambda d: ((at[d][0] - x) ** 2 + (at[d][1] - y) ** 2, d))[:k]


def test_knn_vectors_in_blocks(spark):
    v = np.random.default_rng(1).random((40, 3))
    df = spark.createDataFrame([(i, [float(z) for z in x]) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(r["src"], r["rank"]): r["dst"] for r in neighbors.knn_vectors(df, 4, block=9).collect()}
    for i in range(40):
        order = np.lexsort((np.arange(40), ((v - v[i]) ** 2).sum(1)))[:4]
        assert [got[i, r] for r in range(1, 5)] == order.tolist()


def test_adjacency_and_moran(spark):
    assert neighbors.adjacency(grid(spark, 5)).count() == 72
    smooth, flat = rigor.morans_i(grid(spark, 5, lambda x, y: x), "v").first()["i"], rigor.morans_i(grid(spark, 5), "v").first()["i"]
    assert smooth > 0.5 and flat is None
    p = rigor.morans_i_permutation(grid(spark, 5, lambda x, y: x), "v", n_perm=39).first()
    assert p["p"] == pytest.approx(1 / 40)


def test_stripes(spark):
    import math

    r = rigor.channel_stripes(grid(spark, 10, lambda x, y: math.sin(y * 1.3) * 3), "v").first()
    assert r["col_dominance"] > 0.9 and r["stripe_artifact"]
    assert not rigor.channel_stripes(grid(spark, 5), "v").first()["stripe_artifact"]


@pytest.mark.parametrize("win", [3, 5])
def test_genome_smooth(spark, win):
    values = [5.0, 1.0, 4.0, 2.0, 9.0, 3.0, 3.5]
    layer = spark.createDataFrame([("s", 0, i, v) for i, v in enumerate(values)] + [("s", 0, 9, 7.0)], "sample string, spot_id int, bin_id int, value double")
    bins = spark.createDataFrame([("s", i, "chr1") for i in range(7)] + [("s", 9, "chr2")], "sample string, bin_id int, chr string")
    got = [r["value"] for r in copynumber.genome_smooth(layer, bins, win).orderBy("bin_id").collect()]
    padded = [values[0]] * (win // 2) + values + [values[-1]] * (win // 2)
    assert got == [float(np.median(padded[i : i + win])) for i in range(7)] + [7.0]
    with pytest.raises(ValueError):
        copynumber.genome_smooth(layer, bins, 4)


def planted(spark, sd, blocks, n=200, seed=0):
    y = 2.0 + np.random.default_rng(seed).normal(0, sd, n)
    for a, b, v in blocks:
        y[a:b] += v
    profile = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "sample string, bin_id int, value double")
    bins = spark.createDataFrame([(i, "chr8" if i < n // 2 else "chr9", i * 1_000_000, (i + 1) * 1_000_000) for i in range(n)], "bin_id int, chr string, start long, end long")
    return profile, bins


def test_segments_find_planted_steps(spark):
    profile, bins = planted(spark, 0.03, [(20, 60, 0.6), (130, 150, -0.5)])
    seg = segments.segment(profile, bins)
    got = {(r["first_bin"], r["last_bin"] + 1) for r in seg.collect()}
    assert {(20, 60), (130, 150)} <= got
    info = segments.segment_summary(seg, profile, bins).first()
    assert not info["flat_genome"] and info["var_explained"] > 0.9
    flat, bins = planted(spark, 0.03, [], seed=1)
    assert segments.segment(flat, bins).count() <= 4


def test_integer_copy_numbers(spark):
    profile, bins = planted(spark, 0.02, [(20, 60, 0.5), (130, 150, -0.5)])
    seg, info = segments.integer_cn(segments.segment(profile, bins))
    r = info.first()
    assert abs(r["purity"] - 0.5) < 0.05 and r["resolvable"]
    cn = {x["first_bin"]: x["integer_cn"] for x in seg.collect()}
    assert cn[20] == 3 and cn[130] == 1
    flat, bins = planted(spark, 0.02, [], seed=1)
    assert segments.integer_cn(segments.segment(flat, bins))[1].first()["purity"] is None


def test_variance_decomposition_against_lstsq(spark):
    rng = np.random.default_rng(2)
    spots = grid(spark, 8)
    rows = spots.collect()
    kinds = rng.choice(["Tumor", "Immune", "Stroma"], len(rows)).tolist()
    labels = rng.choice(["a", "b", "c"], len(rows)).tolist()
    cells = spark.createDataFrame([(r["spot_id"], r["x_id"], r["y_id"], k) for r, k in zip(rows, kinds)], "spot_id int, x_id int, y_id int, cell_type string")
    dna = spark.createDataFrame([(r["spot_id"], r["x_id"], r["y_id"], k) for r, k in zip(rows, labels)], "spot_id int, x_id int, y_id int, clone string")
    y = rng.normal(size=(len(rows), 3))
    expr = spark.createDataFrame([(r["spot_id"], f"g{j}", float(y[i, j])) for i, r in enumerate(rows) for j in range(3)], "spot_id int, gene string, value double")
    got = {r["gene"]: r for r in multimodal.variance_decomposition(expr, dna, cells, k_density=7, extent=8).collect()}
    d = {r["spot_id"]: (r["td"], r["imd"]) for r in multimodal.densities(multimodal.align_spots(dna, cells), ("Tumor",), ("Immune",), 7, 8).collect()}
    dens = np.array([d[r["spot_id"]] for r in rows])
    dummy = np.array([[x == "b", x == "c"] for x in labels], float)
    one = np.ones((len(rows), 1))
    rss = lambda x, v: ((v - x @ np.linalg.lstsq(x, v, rcond=None)[0]) ** 2).sum()
    for j in range(3):
        v = y[:, j] - y[:, j].mean()
        full, a, b, t = rss(np.hstack([one, dummy, dens]), v), rss(np.hstack([one, dens]), v), rss(np.hstack([one, dummy]), v), (v**2).sum()
        r = got[f"g{j}"]
        np.testing.assert_allclose([r["vd_genetic"], r["vd_microenv"], r["vd_residual"]], [(a - full) / t, (b - full) / t, full / t], atol=1e-9)


def test_barcodes(spark, tmp_path):
    refs = spark.createDataFrame([(1, "AAAAAAAA"), (2, "AAAAAATT"), (3, "CCCCCCCC")], "ref_index int, code string")
    q = spark.createDataFrame([("AAAAAAAA",), ("AAAAAAAT",), ("CCCCCCCG",), ("CCCCNCCC",), ("GGGGGGGG",), ("ACG",), ("ccccccca",)], "h string")
    got = {r["h"]: (r["status"], r["match"], r["mm"]) for r in barcodes.match_halves(q, refs, "h").collect()}
    assert got["AAAAAAAA"] == ("exact", "AAAAAAAA", 0) and got["AAAAAAAT"] == ("ambiguous", None, 1) and got["CCCCNCCC"] == ("corrected", "CCCCCCCC", 1)
    assert got["GGGGGGGG"] == ("unmapped", None, None) and got["ACG"] == ("bad_length", None, None) and got["ccccccca"][0] == "corrected"
    (tmp_path / "r.txt").write_text("ACGTACGT\nACGTACGA\n")
    assert barcodes.read_barcode_reference(spark, str(tmp_path / "r.txt"), "X").count() == 2
    (tmp_path / "b.txt").write_text("ACGTACGT\nACGTACGT\n")
    with pytest.raises(ValueError):
        barcodes.read_barcode_reference(spark, str(tmp_path / "b.txt"), "X")


def test_read_pairs(spark, tmp_path):
    r1 = "A" * 8 + reads.LINKER + "C" * 8 + "T" * 100
    (tmp_path / "x_R1.fastq").write_text(f"@q/1 c\n{r1}\n+\n{'I' * len(r1)}\n@p/1\nACG\n+\nIII\n")
    (tmp_path / "x_R2.fastq").write_text("@q/2 c\nGGGG\n+\nIIII\n@p/2\nGG\n+\nII\n")
    register(spark)
    pairs = spark.read.format("fastq_pair").option("path", str(tmp_path / "*_R1.fastq")).load()
    for anchor in (False, True):
        out = reads.extract_barcodes(pairs, anchor=anchor).orderBy("ord").collect()
        assert out[0]["barcode"] == "A" * 8 + "C" * 8 and out[0]["drop_reason"] is None
        assert out[1]["drop_reason"] == ("no_linker" if anchor else "r1_too_short_for_barcode")
    line = reads.fastq_lines(reads.extract_barcodes(pairs)).first()["r1"]
    assert line.startswith("@q_CB=AAAAAAAACCCCCCCC/1\n") and line.endswith("I" * 21)
    (tmp_path / "g.fa").write_text(">chrT x\nACGTN\nGGCC\n")
    got = spark.read.format("fasta_bins").option("path", str(tmp_path / "g.fa")).option("bin_size", 4).load().collect()
    assert sorted((r["bin"], r["seq"]) for r in got) == [(0, "ACGT"), (1, "GGC"), (1, "N"), (2, "C")]


def test_interval_fraction(spark):
    bins = build_bins(spark, 10_000_000)
    iv = spark.createDataFrame([("chr1", 5_000_000, 15_000_000), ("chr1", 9_000_000, 10_000_000)], "chr string, start long, end long")
    got = {r["bin_id"]: r["fraction"] for r in interval_fraction(iv, bins, 10_000_000).where("fraction > 0").collect()}
    assert got == {0: pytest.approx(0.6), 1: pytest.approx(0.5)}


def test_clustering_and_agreement(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 2}", i, [float(v) for v in rng.normal(0, 0.1, 2) + (5 if i % 4 < 2 else 0)], int(i % 4 < 2)) for i in range(80)]
    points = spark.createDataFrame(rows, "sample string, spot_id int, pcs array<double>, truth int")
    labels, chosen = clones.choose_k(points, kmax=3, tries=2)
    for r in chosen.collect():
        assert r["k"] == 2 and {x["k"]: x["ch"] for x in r["ch_scores"]}.keys() == {2, 3}
    both = labels.join(points, ["sample", "spot_id"])
    for s in ("s0", "s1"):
        one = both.where(F.col("sample") == s)
        assert clones.adjusted_rand_index(one, "truth", "cluster").first()["ari"] == pytest.approx(1.0)
        index = clones.calinski_harabasz(one, "cluster", "pcs").first()["ch"]
        assert index == pytest.approx(next(x["ch"] for x in chosen.where(F.col("sample") == s).first()["ch_scores"] if x["k"] == 2))
    same = spark.createDataFrame([("a", i, [1.0, 1.0]) for i in range(5)], "sample string, spot_id int, pcs array<double>")
    assert clones.choose_k(same)[1].first()["k"] == 2  # no index is defined


def test_k_means_finds_the_least_cost():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.2, (6, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    labels = clones.k_means(x, 3, 10, np.random.default_rng(0))
    assert labels.tolist() == [0] * 6 + [1] * 6 + [2] * 6
    assert clones.variance_ratio(x, np.zeros(18, int)) is None and clones.variance_ratio(x, labels) > 100


def test_components_against_svd_and_missing_bins(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(7, 4))
    x[2, 1] = 0.0
    rows = [(s, i, 10 * j, float(x[i, j] + (s == "b"))) for s in "ab" for i in range(7) for j in range(4) if (i, j) != (2, 1) or s == "b"]
    got = clones.pca_scores(spark.createDataFrame(rows, "sample string, spot_id int, bin_id int, value double"), 3).toPandas()
    c = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    want = (u * s)[:, :3] * np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(axis=1)])
    for name in "ab":  # a shift of all values changes nothing, and a bin that a spot lacks shifts no other
        part = got[got["sample"] == name].sort_values("spot_id")
        np.testing.assert_allclose(np.stack(part.pcs), want, atol=1e-9)
    np.testing.assert_allclose(np.abs(clones.principal_components(x.T, 2)), np.abs((lambda r: (r[0] * r[1])[:, :2])(np.linalg.svd(x.T - x.T.mean(axis=0), full_matrices=False))), atol=1e-9)


def test_two_samples_stay_apart(spark):
    """Neighbours, smoothing, profiles and decomposition of two samples together are those of each alone."""
    rng = np.random.default_rng(8)
    one = [(i, int(i // 5 + 1), int(i % 5 + 1), [float(v) for v in rng.normal(size=2)]) for i in range(25)]
    make = lambda names: spark.createDataFrame([(s, i, x, y, 10, [v + 9.0 * (s == "b") for v in p]) for s in names for i, x, y, p in one], "sample string, spot_id int, x_id int, y_id int, total_frags long, pcs array<double>")
    alone, both = make("a"), make("ab")
    near = neighbors.knn_vectors(both, 3, key="spot_id", vector="pcs", by="sample").toPandas()
    assert len(near) == 150 and near.groupby(["sample", "src"]).dst.nunique().eq(3).all()
    smooth = lambda df: {(r["sample"], r["spot_id"]): np.array(r["pcs"]) for r in clones.double_smooth(df, df, k_pc=4, k_xy=4, k_join=3, extent=5).collect()}
    want, got = smooth(alone), smooth(both)
    assert len(got) == 50
    for (_, i), v in want.items():
        np.testing.assert_allclose([got["a", i], got["b", i] - 9.0], [v, v], atol=1e-9)
    log2 = spark.createDataFrame([(s, i, b, 0.01 * ((i * 7 + b) % 5) + (0.9 if (i < 5) == (s == "a") and b < 3 else 0.0)) for s in "ab" for i in range(10) for b in range(6)], "sample string, spot_id int, bin_id int, value double")
    labels = spark.createDataFrame([(s, i, int(i < 5)) for s in "ab" for i in range(10)], "sample string, spot_id int, cluster int")
    names, profiles = clones.clone_profiles(log2, labels, 6)
    assert {(r["sample"], r["cluster"]): r["clone"] for r in names.collect()} == {("a", 1): "Clone1", ("a", 0): "Normal", ("b", 0): "Clone1", ("b", 1): "Normal"}
    each = clones.clone_profiles(log2.where("sample = 'b'"), labels.where("sample = 'b'"), 6)[1]
    key = lambda df: sorted((r["clone"], r["bin_id"], round(r["cna"], 9)) for r in df.where("sample = 'b'").collect())
    assert key(profiles) == key(each) and len(key(each)) == 12


def test_clone_diagnostics_by_sample(spark):
    profiles = spark.createDataFrame([("a", "Normal", 0, 0.0), ("a", "Clone1", 0, 0.5), ("a", "Clone1", 1, 0.1), ("a", "Normal", 1, 0.0)], "sample string, clone string, bin_id int, cna double")
    chosen = spark.createDataFrame([("a", 2, [(2, 9.0), (3, 4.0)]), ("b", 3, [(2, 1.0), (3, 4.0)])], "sample string, k int, ch_scores array<struct<k:int,ch:double>>")
    got = {r["sample"]: tuple(r)[1:] for r in clones.clone_diagnostics(profiles, 10, chosen).collect()}
    assert got == {"a": (0.1, 2, False, False), "b": (0.0, 3, True, True)}
    with pytest.raises(ValueError):
        clones.call_clones(None, profiles, 10)


def test_monte_carlo_agrees_with_the_closed_form(spark):
    spots = grid(spark, 6).withColumn("total_frags", F.lit(40).cast("long"))
    counts = spots.select("sample", "spot_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("bin_id")).withColumn("n", (F.col("spot_id") % 5 + 1).cast("long"))
    bins = spark.createDataFrame([(0, "chr8", 0), (1, "chr1", 0)], "bin_id int, chr string, start long")
    a = rigor.region_significance(counts, spots, bins, ["chr8"], k_xy=5, extent=6)
    b = rigor.permutation_significance(counts, spots, bins, ["chr8"], n_perm=400, k_xy=5, extent=6)
    x, y = ({r["spot_id"]: r["z"] for r in df.collect()} for df in (a, b))
    assert max(abs(x[k] - y[k]) for k in x) < 0.5


def test_regions_and_samples_have_draws_of_their_own(spark):
    """Regions whose names have the same letters, and two equal samples, must not share their null."""
    one = grid(spark, 5).withColumn("total_frags", F.lit(40).cast("long"))
    spots = one.unionByName(one.withColumn("sample", F.lit("other")))
    counts = spots.select("sample", "spot_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("bin_id")).withColumn("n", F.lit(3).cast("long"))
    bins = spark.createDataFrame([(0, "chr12", 0), (1, "chr21", 0)], "bin_id int, chr string, start long")
    z = rigor.permutation_significance(counts, spots, bins, ["chr12", "chr21"], n_perm=50, k_xy=3, extent=5).toPandas()
    of = {k: g.sort_values("spot_id").z.round(9).tolist() for k, g in z.groupby(["sample", "region"])}
    assert len(of) == 4 and len({tuple(v) for v in of.values()}) == 4


def test_queries_search_as_widely_as_the_operators(spark, monkeypatch):
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    from spotlattice.plans import queries

    pca, choose, moran = MagicMock(), MagicMock(return_value=(MagicMock(), MagicMock())), MagicMock()
    monkeypatch.setattr(queries.clones, "pca_scores", pca)
    monkeypatch.setattr(queries.clones, "choose_k", choose)
    monkeypatch.setattr(queries.rigor, "morans_i_permutation", moran)
    s = SimpleNamespace(log2="log2", spots="spots", smoothed=SimpleNamespace(smoothed="smoothed"))
    monkeypatch.setattr(queries, "rounded", lambda df, *_: df)
    queries.pca_scores(s), queries.kmeans_clones(s), queries.morans_i_permutation_p(s)
    assert pca.call_args_list == [(("log2",),)] and choose.call_args_list == [(("smoothed",),)]
    assert moran.call_args_list == [(("spots", "total_frags"),)]
