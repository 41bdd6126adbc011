"""Readers, sinks, streams, plot-ready tables, and the second stage of the workflow from files to files."""

import gzip

import pytest
from pyspark.sql import functions as F

from spotlattice.functions.genome import build_bins
from spotlattice.operators import barcodes, frames, reads, section_map
from spotlattice.sources import alignments, fragments, sinks, tracks
from spotlattice.streaming import counts_from_stream, read_fragment_stream


def put(path, text):
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(text)
    return str(path)


def test_fragment_and_spot_readers(spark, tmp_path):
    path = put(tmp_path / "f.tsv.gz", "chr1\t5\t9\tAA\t60\nchr1\tx\t9\tAA\t60\nchr2\t1\t2\tCC\t30\n")
    df = fragments.read_fragments(spark, path, 3)
    assert sorted(tuple(r) for r in df.collect()) == [("chr1", 5, 9, "AA", 60), ("chr2", 1, 2, "CC", 30)] and df.rdd.getNumPartitions() == 3
    for name in ("fragments", "count"):
        got = fragments.read_spot_fragments(spark, put(tmp_path / f"{name}.tsv", f"barcode\t{name}\n acgt \t3\n"))
        assert [tuple(r) for r in got.collect()] == [("ACGT", 3)]
    with pytest.raises(ValueError):
        fragments.read_spot_fragments(spark, put(tmp_path / "bad.tsv", "barcode\tn\nA\t1\n"))


def test_alignment_and_annotation_readers(spark, tmp_path):
    sam = alignments.read_sam(spark, put(tmp_path / "a.sam", "@HD\tVN:1.6\nr_CB=ACGT\t99\tchr1\t11\t40\t5M\t=\t60\t120\tACGTA\tIIIII\nshort\t1\n"))
    assert [tuple(r) for r in sam.collect()] == [("r_CB=ACGT", 99, "chr1", 11, 40, 120)]
    assert [tuple(r) for r in reads.fragments_of(reads.proper_q30(sam)).collect()] == [("chr1", 10, 130, "ACGT", 40)]
    line = "chr{}\tsrc\t{}\t{}\t{}\t.\t{}\t.\tgene_id x\n"
    gtf = alignments.read_gtf(spark, put(tmp_path / "g.gtf.gz", "#!genome\n" + line.format(1, "transcript", 100, 200, "+") + line.format(1, "exon", 100, 150, "+") + line.format(2, "mRNA", 5, 50, "-")))
    assert [tuple(r) for r in reads.transcription_starts(gtf).collect()] == [("chr1", 99, 100), ("chr2", 49, 50)]


def test_reference_tracks(spark, tmp_path):
    bins = build_bins(spark, 1_000_000)
    put(tmp_path / "bin_gc_1mb.tsv", "chr\tstart\tend\tgc\tn_acgt\nchr1\t1000000\t2000000\t0.5\t9\n")
    put(tmp_path / "k100.umap.bed.gz", "track name=x\nchr1\t0\t500000\nchr1\t900000\t1100000\nchrUn\t0\t9\nchr1\n")
    put(tmp_path / "hg38-blacklist.v2.bed.gz", "chr2\t0\t250000\thigh\n")
    got = {(r["chr"], r["start"]): r for r in tracks.load_reference_tracks(spark, bins, str(tmp_path)).collect()}
    assert len(got) == bins.count()
    assert got["chr1", 0]["mappability"] == 0.6 and got["chr1", 1_000_000]["mappability"] == 0.1 and got["chr1", 2_000_000]["mappability"] == 0
    assert got["chr1", 1_000_000]["gc"] == 0.5 and got["chr1", 0]["gc"] == 0 and got["chr2", 0]["blacklist"] == 0.25
    part = spark.createDataFrame([(0, 0.7)], "bin_id int, gc double")
    added = {r["bin_id"]: r["gc"] for r in tracks.add_reference(bins, part).where("bin_id < 2").collect()}
    assert added == {0: 0.7, 1: None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int").repartition(2)
    sinks.write_tsv(df, str(tmp_path / "t"), single=True)
    (part,) = (tmp_path / "t").glob("part-*")
    assert sorted(part.read_text().split("\n")) == ["", "a\t1", "b\t2", "k\tn"]
    sinks.write_lines(df, str(tmp_path / "l"), "k")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["a", "b"] and all(p.name.endswith(".gz") for p in (tmp_path / "l").glob("part-*"))
    lines = barcodes.as_metrics(spark.createDataFrame([(1, 2.5)], "x int, y double"))
    assert [tuple(r) for r in lines.collect()] == [("x", "1"), ("y", "2.5")]
    both = reads.qc_summary({"one": lines, "two": lines.limit(1)})
    assert sorted(tuple(r) for r in both.collect()) == [("one", "x", "1"), ("one", "y", "2.5"), ("two", "x", "1")]


def test_plot_tables(spark):
    spots = spark.createDataFrame([("s", 0, 1, 1, 4), ("s", 1, 2, 2, 9)], "sample string, spot_id int, x_id int, y_id int, total_frags int")
    wide = {r["x_id"]: r for r in frames.grid(spots, "total_frags", 3).collect()}
    assert len(wide) == 3 and wide[1]["1"] == 4 and wide[2]["2"] == 9 and wide[3]["3"] is None
    z = spots.select("sample", "spot_id", F.lit("chr8").alias("region"), F.lit(1.5).alias("z"))
    assert frames.significance(z, spots, "chr8").count() == 2
    with pytest.raises(ValueError):
        frames.significance(z, spots, "chr9")
    bins = spark.createDataFrame([(0, "chr1", 0)], "bin_id int, chr string, start long")
    lines = frames.clone_profile_lines(spark.createDataFrame([("s", "Clone1", 0, 0.5)], "sample string, clone string, bin_id int, cna double"), bins)
    assert [tuple(r) for r in lines.collect()] == [("s", "Clone1", 0, "chr1", 0, 0.5)]
    vd = spark.createDataFrame([(s, f"g{i}", i / 10, 0.0) for s in "ab" for i in range(5)], "sample string, gene string, vd_genetic double, vd_microenv double")
    assert sorted((r["sample"], r["gene"]) for r in frames.top_variance_genes(vd, 2).collect()) == [("a", "g3"), ("a", "g4"), ("b", "g3"), ("b", "g4")]


def test_stream_of_fragments_adds_up(spark, tmp_path):
    matched = spark.createDataFrame([("AA", "mapped", 1, 1), ("CC", "mapped", 1, 2)], "barcode_obs string, full_status string, x_id int, y_id int")
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        put(folder / f"{i}.tsv", f"chr1\t{i * 10}\t{i * 10 + 4}\tAA\t60\nchr2\t5\t9\tcc\t60\n")
    counts = counts_from_stream(read_fragment_stream(spark, str(folder), 1), matched)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = counts.writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    batch = fragments.counts_of(fragments.place_fragments(fragments.read_fragments(spark, str(folder)), matched))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.table("running")) == key(batch) and sum(r[3] for r in key(batch)) == 6


def test_a_section_from_files_to_files(spark, tmp_path):
    code = lambda n: "".join("ACGT"[(n >> (2 * i)) & 3] for i in range(8))
    x, y = [code(977 * i + 5) for i in range(192)], [code(1409 * i + 11) for i in range(192)]
    put(tmp_path / "x.txt", "\n".join(x) + "\n")
    put(tmp_path / "y.tsv", "Y_barcode\tY_ref_index\n" + "".join(f"{c}\t{i}\n" for i, c in enumerate(y, 1)))
    inside = x[48] + y[48]  # both selected
    odd = "N" + inside[1:]
    outside = x[0] + y[48]  # x is a reference, but not selected
    spots = [(inside, 5), (odd, 2), (outside, 3), ("ACGT", 1), (inside.lower() + " ", 0)]
    put(tmp_path / "spots.tsv", "barcode\tcount\n" + "".join(f"{b}\t{n}\n" for b, n in spots))
    put(tmp_path / "frags.tsv.gz", "".join(f"chr1\t1\t2\t{b}\t60\n" for b in (inside, odd, outside)) + "short\tline\n")
    tables = section_map.map_section(spark, str(tmp_path / "spots.tsv"), str(tmp_path / "x.txt"), str(tmp_path / "y.tsv"), str(tmp_path / "out"), str(tmp_path / "frags.tsv.gz"))
    status = {(r["barcode_obs"], r["full_status"]) for r in tables["matched_spot_barcodes"].collect()}
    assert {(inside, "mapped"), (odd, "mapped"), (outside, "mapped"), ("ACGT", "bad_length")} == status
    summary = {r["metric"]: r["value"] for r in spark.read.csv(str(tmp_path / "out" / "summary.tsv"), sep="\t", header=True).collect()}
    assert summary["total_fragments_input"] == "11" and summary["mapped_fragments_all_refs"] == "10" and summary["cropped_fragments"] == "7" and summary["fixed_x_n"] == "50" and summary["order"] == "XY"
    crop = spark.read.csv(str(tmp_path / "out" / "top50x50_spot_fragments.tsv"), sep="\t", header=True).collect()
    assert len(crop) == 1 and crop[0]["fragments"] == "7" and crop[0]["barcode_mapped"] == inside
    matrix = spark.read.csv(str(tmp_path / "out" / "top50x50_matrix.tsv"), sep="\t", header=True)
    assert matrix.count() == 50 and len(matrix.columns) == 51
    for name in ("mapped", "top50x50"):
        got = {r[0].split("\t")[3] for r in spark.read.text(str(tmp_path / "out" / f"{name}_fragments_with_cb.tsv.gz")).collect()}
        assert got == {inside, odd}
    counts = {r["metric"]: r["value"] for r in spark.read.csv(str(tmp_path / "out" / "fragment_filter_summary.tsv"), sep="\t", header=True).collect()}
    assert counts == {"input_fragment_lines": "3", "kept_fragments_lines": "2", "selected_obs_barcodes": "2", "selected_mapped_barcodes": "1"}


def test_preview_of_kept_pairs(spark):
    body = "ACGTACGT" + reads.LINKER + "TTTTCCCC" + "ACGT" * 40
    pairs = spark.createDataFrame([(i, f"@r{i}/1 x", body, "I" * len(body), f"@r{i}/2 x", "ACGT", "IIII") for i in range(3)] + [(9, "@r9/1", "AC", "II", "@r9/2", "AC", "II")], "ord int, h1 string, s1 string, q1 string, h2 string, s2 string, q2 string")
    got = reads.preview(reads.extract_barcodes(pairs), "ord", 2).collect()
    assert [(r["read"], r["barcode"], len(r["genomic_head20"])) for r in got] == [("r0", "ACGTACGTTTTTCCCC", 20), ("r1", "ACGTACGTTTTTCCCC", 20)]
