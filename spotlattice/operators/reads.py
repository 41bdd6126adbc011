"""Reads: linkers and barcodes in read pairs, alignment records, and bulk quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlattice.functions.exprs import hamming, ratio

# Fixed values of the assay: the linker between the two barcode halves.
LINKER = "CAGTCATGTCATGAGCTA"


def linker_within(seq: Column, linker: str = LINKER, mismatches: int = 3, prefix: int = 85) -> Column:
    """Whether some window of the first ``prefix`` bases is the linker but for a few mismatches."""
    head = F.substring(seq, 1, prefix)
    n = F.length(head) - len(linker)
    window = lambda i: hamming(F.substring(head, i + 1, F.lit(len(linker))), F.lit(linker)) <= mismatches
    return F.when(n < 0, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), window))


def trim_adapter(seq: Column, adapter: str, least: int = 20) -> Column:
    """seq up to an exact copy of the adapter; null if less than ``least`` bases are left."""
    at = F.instr(seq, adapter)
    out = F.when(at > 0, F.substring(seq, F.lit(1), at - 1)).otherwise(seq)
    return F.when(F.length(out) >= least, out)


def find_linker(seq: Column, linker: str = LINKER, expected: int = 8, shift: int = 3) -> Column:
    """The 0-based place of the linker near the expected one: an exact copy first, else the first with one mismatch; -1."""
    n, lo, hi = len(linker), max(0, expected - shift), expected + shift
    at = lambda i: F.substring(seq, i + 1, F.lit(n))
    places = F.sequence(F.lit(lo), F.lit(hi))
    exact = F.get(F.filter(places, lambda i: at(i) == linker), F.lit(0))
    near = F.get(F.filter(places, lambda i: F.coalesce(hamming(at(i), F.lit(linker)) <= 1, F.lit(False))), F.lit(0))
    return F.coalesce(exact, near, F.lit(-1))


def name_and_mate(header: Column) -> tuple[Column, Column]:
    """'@NAME/1 comment' -> NAME and '/1' (or '')."""
    name = F.regexp_extract(F.regexp_replace(header, "^@", ""), r"^([^ \t\n]*)", 1)
    mate = F.regexp_extract(name, r"(/[12])$", 1)
    return F.regexp_replace(name, r"/[12]$", ""), mate


def extract_barcodes(pairs: DataFrame, *, seq_start: int = 113, bc2: tuple[int, int] = (0, 8), bc1: tuple[int, int] = (26, 34), order: str = "BC2BC1", min_r1_len: int = 20, anchor: bool = False, linker: str = LINKER, max_shift: int = 3) -> DataFrame:
    """pairs(h1, s1, q1, h2, s2, q2, ...) with bc2, bc1, barcode, g_seq, g_qual and drop_reason (null if the pair is kept).

    Reasons come in the order in which a pair is tested: no_linker or r1_too_short_for_barcode, bad_barcode,
    short_genomic_R1. With ``anchor`` everything moves with the linker that was found.
    """
    n2, n1 = bc2[1] - bc2[0], bc1[1] - bc1[0]
    s = F.col("s1")
    if anchor:
        df = pairs.withColumn("__pos", find_linker(s, linker.upper(), bc2[1], max_shift))
        pos = F.col("__pos")
        first = F.when(pos < 0, "no_linker")
        b2 = F.when(pos >= n2, F.substring(s, pos - n2 + 1, F.lit(n2))).otherwise("")
        b1 = F.substring(s, pos + len(linker) + 1, F.lit(n1))
        start = F.lit(seq_start) + pos - bc2[1]
    else:
        df = pairs
        first = F.when(F.length(s) < bc1[1], "r1_too_short_for_barcode")
        b2, b1, start = F.substring(s, bc2[0] + 1, n2), F.substring(s, bc1[0] + 1, n1), F.lit(seq_start)
    rest = lambda c: F.substring(F.col(c), start + 1, F.greatest(F.length(c) - start, F.lit(0)))
    df = df.withColumns({"bc2": b2, "bc1": b1, "g_seq": rest("s1"), "g_qual": rest("q1")})
    bad = F.when((F.length("bc2") != n2) | (F.length("bc1") != n1), "bad_barcode")
    short = F.when(F.length("g_seq") < min_r1_len, "short_genomic_R1")
    code = F.concat("bc2", "bc1") if order == "BC2BC1" else F.concat("bc1", "bc2")
    return df.withColumns({"drop_reason": F.coalesce(first, bad, short), "barcode": code}).drop("__pos")


def fastq_lines(kept: DataFrame) -> DataFrame:
    """The two FASTQ records of each kept pair: the barcode goes into both names."""
    base, m1 = name_and_mate(F.col("h1"))
    _, m2 = name_and_mate(F.col("h2"))
    name = F.concat(F.lit("@"), base, F.lit("_CB="), "barcode")
    record = lambda mate, default, s, q: F.concat_ws("\n", F.concat(name, F.when(mate == "", default).otherwise(mate)), s, F.lit("+"), q)
    return kept.where("drop_reason is null").select(record(m1, "/1", F.col("g_seq"), F.col("g_qual")).alias("r1"), record(m2, "/2", F.col("s2"), F.col("q2")).alias("r2"))


def barcode_counts(extracted: DataFrame, top: int | None = None) -> DataFrame:
    df = extracted.where("drop_reason is null").groupBy("barcode").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "barcode")
    return df.limit(top) if top else df


def preview(extracted: DataFrame, order: str, n: int = 100) -> DataFrame:
    base, _ = name_and_mate(F.col("h1"))
    return extracted.where("drop_reason is null").orderBy(order).limit(n).select(base.alias("read"), F.col("bc2").alias("BC2"), F.col("bc1").alias("BC1"), "barcode", F.substring("g_seq", 1, 20).alias("genomic_head20"))


def drop_stats(extracted: DataFrame) -> DataFrame:
    """metric, value: totals, one line for each reason that occurs, distinct barcodes, and the kept share (4 places)."""
    kept = F.sum(F.when(F.col("drop_reason").isNull(), 1).otherwise(0))
    one = extracted.agg(F.count("*").alias("t"), F.coalesce(kept, F.lit(0)).alias("k"), F.countDistinct(F.when(F.col("drop_reason").isNull(), F.col("barcode"))).alias("u"))
    share = F.coalesce(ratio(F.col("k"), F.col("t")), F.lit(0.0))
    named = {"total_pairs": F.col("t"), "kept_pairs": F.col("k"), "dropped_pairs": F.col("t") - F.col("k"), "unique_barcodes": F.col("u"), "kept_fraction": F.format_string("%.4f", share)}
    lines = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("string").alias("value")) for m, v in named.items()])).alias("m")).select("m.*")
    reasons = extracted.where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("c"))
    return lines.unionByName(reasons.select(F.concat(F.lit("dropped_"), "drop_reason").alias("metric"), F.col("c").cast("string").alias("value")))


def flags(require: int = 0, exclude: int = 0, min_mapq: int = 0) -> Column:
    """Of alignment records with flag and mapq: all required bits, none of the excluded, and the quality."""
    f = F.col("flag")
    return (f.bitwiseAND(F.lit(require)) == require) & (f.bitwiseAND(F.lit(exclude)) == 0) & (F.col("mapq") >= min_mapq)


def proper_q30(sam: DataFrame) -> DataFrame:
    return sam.where(flags(2, 1804, 30))


def cell_barcode(qname: Column) -> Column:
    """The letters after CB= in a read's name; null if there are none."""
    return F.nullif(F.regexp_extract(qname, "CB=([A-Z]+)", 1), F.lit(""))


def cb_counts(sam: DataFrame) -> DataFrame:
    """barcode, fragments of first mates of proper pairs."""
    return sam.where(flags(67)).select(cell_barcode(F.col("qname")).alias("barcode")).where("barcode is not null").groupBy("barcode").agg(F.count("*").alias("fragments"))


def fragments_of(sam: DataFrame) -> DataFrame:
    """chr, start, end, cb ('NA' if none), mapq of first mates of proper pairs."""
    start = F.col("pos") - 1
    return sam.where(flags(67)).select("chr", start.alias("start"), (start + F.abs("tlen")).alias("end"), F.coalesce(cell_barcode(F.col("qname")), F.lit("NA")).alias("cb"), "mapq")


def length_histogram(sam: DataFrame, longest: int = 1000) -> DataFrame:
    n = F.abs("tlen")
    return sam.where(flags(2)).where((n > 0) & (n <= longest)).groupBy(n.alias("length")).agg(F.count("*").alias("count"))


def cut_sites(alignments: DataFrame) -> DataFrame:
    """The one-base 5' end of each alignment(chr, start, end, strand)."""
    s = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end") - 1)
    return alignments.select("chr", s.alias("start"), (s + 1).alias("end"), "strand")


def transcription_starts(gtf: DataFrame) -> DataFrame:
    """chr, start, end of the first base of every transcript of gtf(chr, feature, start, end, strand), distinct."""
    t = F.when(F.col("strand") == "+", F.col("start") - 1).when(F.col("strand") == "-", F.col("end") - 1)
    e = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))
    rows = gtf.where(F.col("feature").isin("transcript", "mRNA") & F.col("strand").isin("+", "-"))
    return rows.select("chr", F.greatest(t, F.lit(0)).alias("start"), e.alias("end")).distinct().orderBy("chr", "start", "end")


def tss_profile(tss: DataFrame, cuts: DataFrame, reach: int = 2000, step: int = 10) -> DataFrame:
    """offset, count of cut sites around starts, from -reach up to reach in steps. A band join by buckets of ``reach``."""
    t = tss.select("chr", F.col("start").alias("t")).withColumn("b", F.explode(F.array(*[F.floor(F.col("t") / reach) + d for d in (-1, 0, 1)])))
    c = cuts.select("chr", F.col("start").alias("c"), F.floor(F.col("start") / reach).alias("b"))
    near = t.join(c, ["chr", "b"]).where(F.col("c").between(F.col("t") - reach, F.col("t") + reach - 1))
    counts = near.groupBy(F.expr(f"(c - t + {reach}) div {step}").cast("int").alias("i")).agg(F.count("*").alias("count"))
    every = tss.sparkSession.range(2 * reach // step).select(F.col("id").cast("int").alias("i"))
    return every.join(counts, "i", "left").select((F.col("i") * step - reach).alias("offset"), F.coalesce("count", F.lit(0)).alias("count"))


def tss_enrichment(profile: DataFrame) -> DataFrame:
    """Mean count within 50 bases over that between 1,500 and 2,000 on both sides; null if that is none."""
    o = F.col("offset")
    peak, flank = F.when(o.between(-50, 50), F.col("count")), F.when(o.between(-2000, -1500) | o.between(1500, 2000), F.col("count"))
    return profile.agg(ratio(F.avg(peak), F.avg(flank)).alias("tss_enrichment"))


def frip(reads: DataFrame, peaks: DataFrame, bucket: int = 10_000) -> DataFrame:
    """total_reads, in_peak_reads, frip of reads(chr, start, end) that overlap any peak: a semi-join by buckets."""
    spread = lambda df: df.withColumn("b", F.explode(F.expr(f"sequence(start div {bucket}L, greatest(end - 1, start) div {bucket}L)")))
    rows = reads.withColumn("id", F.monotonically_increasing_id())
    r, p = spread(rows), spread(peaks).select("chr", "b", F.col("start").alias("ps"), F.col("end").alias("pe"))
    hit = r.join(p, (r["chr"] == p["chr"]) & (r["b"] == p["b"]) & (r["start"] < p["pe"]) & (p["ps"] < r["end"]), "left_semi")
    n = hit.agg(F.countDistinct("id").alias("in_peak_reads"))
    return reads.agg(F.count("*").alias("total_reads")).join(n).select("total_reads", "in_peak_reads", F.coalesce(ratio(F.col("in_peak_reads"), F.col("total_reads")), F.lit(0.0)).alias("frip"))


def qc_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """The (metric, value) lines of several tables, with the table's name."""
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("source"), "metric", F.col("value").cast("string").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
