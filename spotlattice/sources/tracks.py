"""Bias tracks: GC by lookup, and the covered fraction of bins by intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.functions.exprs import ratio
from spotlattice.functions.genome import bin_offsets, chromosomes


def read_bed(spark: SparkSession, path: str, genome: str = "hg38") -> DataFrame:
    """chr, start, end of the lines of a BED file (.gz or not) that have three fields and a known chromosome."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("track")).select(parts.alias("p")).where(F.size("p") >= 3)
    return lines.select(F.col("p")[0].alias("chr"), F.col("p")[1].cast("long").alias("start"), F.col("p")[2].cast("long").alias("end")).where(F.col("chr").isin(chromosomes(genome)))


def interval_fraction(intervals: DataFrame, bins: DataFrame, bin_size: int, genome: str = "hg38") -> DataFrame:
    """bin_id, fraction: covered bases over bin_size (also for a last bin that is shorter); overlaps count twice.

    An interval is split into the bins it touches, so that a range join becomes an aggregate by bin.
    """
    cut = intervals.where("end > start").join(F.broadcast(bin_offsets(intervals.sparkSession, bin_size, genome)), "chr")
    cut = cut.withColumn("b", F.explode(F.expr(f"sequence(start div {bin_size}L, (end - 1) div {bin_size}L)"))).where("b < n_bins")
    bases = F.expr(f"least(end, (b + 1) * {bin_size}L) - greatest(start, b * {bin_size}L)")
    sums = cut.groupBy((F.col("off") + F.col("b")).cast("int").alias("bin_id")).agg(F.sum(bases).alias("s"))
    return bins.select("bin_id").join(sums, "bin_id", "left").select("bin_id", (F.coalesce("s", F.lit(0)) / F.lit(float(bin_size))).alias("fraction"))


def gc_lookup(bins: DataFrame, gc: DataFrame, bin_size: int) -> DataFrame:
    """bins with gc from a table (chr, start, gc) by chromosome and bin; 0 where it has none."""
    right = gc.select("chr", F.expr(f"start div {bin_size}L").alias("b"), "gc")
    return bins.drop("gc").withColumn("b", F.expr(f"start div {bin_size}L")).join(right, ["chr", "b"], "left").drop("b").withColumn("gc", F.coalesce("gc", F.lit(0.0)))


def load_reference_tracks(spark: SparkSession, bins: DataFrame, ref_dir: str, bin_size: int = 1_000_000, genome: str = "hg38") -> DataFrame:
    gc = spark.read.csv(f"{ref_dir}/bin_gc_1mb.tsv", sep="\t", header=True, schema="chr string, start long, end long, gc double, n_acgt long")
    out = gc_lookup(bins, gc, bin_size)
    for name, file in (("mappability", "k100.umap.bed.gz"), ("blacklist", "hg38-blacklist.v2.bed.gz")):
        part = interval_fraction(read_bed(spark, f"{ref_dir}/{file}", genome), bins, bin_size, genome)
        out = out.drop(name).join(part.withColumnRenamed("fraction", name), "bin_id")
    return out


def add_reference(bins: DataFrame, tracks: DataFrame) -> DataFrame:
    """Attach any of gc, mappability and blacklist from a table by bin_id."""
    new = [c for c in tracks.columns if c != "bin_id"]
    return bins.drop(*new).join(tracks, "bin_id", "left")


def gc_of_sequence(pieces: DataFrame) -> DataFrame:
    """(chr, bin, seq) pieces of sequence -> chr, bin, gc, n_acgt; the case does not matter, other letters don't count."""
    each = pieces.select("chr", "bin", F.regexp_count("seq", F.lit("[GCgc]")).alias("g"), F.regexp_count("seq", F.lit("[ACGTacgt]")).alias("n"))
    sums = each.groupBy("chr", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n_acgt"))
    return sums.select("chr", "bin", F.coalesce(ratio(F.col("g"), F.col("n_acgt")), F.lit(0.0)).alias("gc"), "n_acgt")
