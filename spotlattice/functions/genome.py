"""The genome's chromosomes and their tiling into bins, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Chromosome lengths of the assembly hg38 (chromosomes 1 to 22 and X).
HG38 = {
    "chr1": 248956422, "chr2": 242193529, "chr3": 198295559, "chr4": 190214555, "chr5": 181538259, "chr6": 170805979,
    "chr7": 159345973, "chr8": 145138636, "chr9": 138394717, "chr10": 133797422, "chr11": 135086622, "chr12": 133275309,
    "chr13": 114364328, "chr14": 107043718, "chr15": 101991189, "chr16": 90338345, "chr17": 83257441, "chr18": 80373285,
    "chr19": 58617616, "chr20": 64444167, "chr21": 46709983, "chr22": 50818468, "chrX": 156040895,
}
GENOMES = {"hg38": HG38}
# Gene anchors (chromosome, Mb) for interpretation, and the loci that a cohort is compared at.
GENE_ANCHORS = {"KRAS": ("chr12", 25.21), "CDKN2A": ("chr9", 21.97), "TP53": ("chr17", 7.67), "SMAD4": ("chr18", 51.03), "MYC": ("chr8", 127.74), "GATA6": ("chr18", 22.17)}
COHORT_LOCI = {"CDKN2A(9p)": ("chr9", 21.0), "MYC(8q)": ("chr8", 127.0), "KRAS(12p)": ("chr12", 25.0), "TP53(17p)": ("chr17", 7.0), "SMAD4(18q)": ("chr18", 51.0), "GATA6(18q11)": ("chr18", 22.0)}


def chromosomes(genome: str = "hg38") -> list[str]:
    """In genome order, which is that of the table above."""
    return list(GENOMES[genome])


def is_autosome(col):
    return ~col.isin("chrX", "chrY", "chrM")


def chrom_table(spark: SparkSession, genome: str = "hg38") -> DataFrame:
    rows = [(c, i, n) for i, (c, n) in enumerate(GENOMES[genome].items())]
    return spark.createDataFrame(rows, "chr string, ord int, size long")


def build_bins(spark: SparkSession, bin_size: int = 1_000_000, genome: str = "hg38") -> DataFrame:
    """bin_id, chr, start, end: each chromosome tiled by bins of bin_size, the last one cut short, in genome order."""
    rows, off = [], 0
    for i, (c, n) in enumerate(GENOMES[genome].items()):
        rows.append((c, i, n, off))
        off += -(-n // bin_size)
    chrom = spark.createDataFrame(rows, "chr string, ord int, size long, off int")
    b = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {bin_size}L")))
    tiled = chrom.withColumn("b", b)
    return tiled.select((F.col("off") + F.col("b")).cast("int").alias("bin_id"), "chr", (F.col("b") * bin_size).alias("start"), F.least((F.col("b") + 1) * bin_size, "size").alias("end"))


def bin_offsets(spark: SparkSession, bin_size: int = 1_000_000, genome: str = "hg38") -> DataFrame:
    """chr, off (first bin_id) and n_bins: a table of one row a chromosome, to be broadcast."""
    rows, off = [], 0
    for c, n in GENOMES[genome].items():
        rows.append((c, off, -(-n // bin_size)))
        off += rows[-1][2]
    return spark.createDataFrame(rows, "chr string, off int, n_bins int")


def n_bins(bin_size: int = 1_000_000, genome: str = "hg38") -> int:
    return sum(-(-n // bin_size) for n in GENOMES[genome].values())
