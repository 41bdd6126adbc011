"""Fragments and matrices into the data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.dataset import SCHEMAS, SpatialDataset
from spotlattice.functions.genome import bin_offsets, build_bins


def read_fragments(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A headerless tab-separated file (.gz or not); malformed lines are dropped. A gzip file is one split, so it can be dealt out."""
    df = spark.read.csv(path, sep="\t", schema=SCHEMAS["fragments"], mode="DROPMALFORMED")
    return df.repartition(partitions) if partitions else df


def read_spot_fragments(spark: SparkSession, path: str) -> DataFrame:
    """barcode (trimmed, in capitals) and fragments of a table with a header; its count may be called ``count``."""
    df = spark.read.csv(path, sep="\t", header=True)
    count = next((c for c in ("fragments", "count") if c in df.columns), None)
    if "barcode" not in df.columns or count is None:
        raise ValueError("a table of barcodes needs the columns barcode and fragments (or count)")
    return df.select(F.upper(F.trim("barcode")).alias("barcode"), F.col(count).cast("long").alias("fragments"))


def place_fragments(fragments: DataFrame, matched: DataFrame, *, sample: str = "s0", bin_size: int = 1_000_000, genome: str = "hg38", grid: int = 50) -> DataFrame:
    """sample, spot_id, x_id, y_id, bin_id of every fragment with a mapped barcode in the grid, by its midpoint.

    Of a barcode that is listed more than once the last one (by ``ord``, if there is such a column) counts. Barcodes are
    compared in upper case.
    """
    spark = fragments.sparkSession
    m = matched.where("full_status = 'mapped' and barcode_obs is not null and x_id is not null and y_id is not null")
    rank = F.col("ord") if "ord" in matched.columns else F.struct("x_id", "y_id")
    m = m.groupBy(F.upper("barcode_obs").alias("cb")).agg(F.max_by(F.struct("x_id", "y_id"), rank).alias("xy"))
    m = m.select("cb", F.col("xy.x_id").cast("int").alias("x_id"), F.col("xy.y_id").cast("int").alias("y_id")).where(F.col("x_id").between(1, grid) & F.col("y_id").between(1, grid))
    f = fragments.withColumn("cb", F.upper("cb")).select("cb", "chr", F.expr("(start + end) div 2").alias("mid"))
    f = f.join(F.broadcast(bin_offsets(spark, bin_size, genome)), "chr").join(m, "cb")
    b = F.least(F.expr(f"mid div {bin_size}L"), F.col("n_bins") - 1)
    return f.select(F.lit(sample).alias("sample"), ((F.col("x_id") - 1) * grid + F.col("y_id") - 1).cast("int").alias("spot_id"), "x_id", "y_id", (F.col("off") + b).cast("int").alias("bin_id"))


def counts_of(placed: DataFrame) -> DataFrame:
    """Fragments of each spot and bin; zeros are implicit."""
    return placed.groupBy("sample", "spot_id", "bin_id").agg(F.count("*").alias("n"))


def spots_of(placed: DataFrame) -> DataFrame:
    """The spots with any fragment, and their totals."""
    return placed.groupBy("sample", "spot_id", "x_id", "y_id").agg(F.count("*").alias("total_frags"))


def from_pipeline(fragments: DataFrame, matched: DataFrame, *, sample: str = "s0", bin_size: int = 1_000_000, genome: str = "hg38", grid: int = 50) -> SpatialDataset:
    """Empty spots are not in the result."""
    placed = place_fragments(fragments, matched, sample=sample, bin_size=bin_size, genome=genome, grid=grid)
    meta = {"sample": sample, "grid": str(grid), "bin_size": str(bin_size), "genome": genome}
    return SpatialDataset(spots_of(placed), build_bins(fragments.sparkSession, bin_size, genome), counts_of(placed), meta=meta)


def from_matrix(spark: SparkSession, matrix, bins: DataFrame, *, xs=None, ys=None, sample: str = "s0", grid: int | None = None) -> SpatialDataset:
    """A dense matrix of spots by bins. Coordinates default to the grid row by row; empty spots are kept."""
    n = len(matrix)
    side = grid or round(n**0.5)
    xs = list(xs) if xs is not None else [i // side + 1 for i in range(n)]
    ys = list(ys) if ys is not None else [i % side + 1 for i in range(n)]
    rows = [(sample, i, int(xs[i]), int(ys[i]), [int(v) for v in matrix[i]]) for i in range(n)]
    wide = spark.createDataFrame(rows, "sample string, spot_id int, x_id int, y_id int, v array<long>")
    counts = wide.select("sample", "spot_id", F.posexplode("v").alias("bin_id", "n")).where("n <> 0")
    spots = wide.select("sample", "spot_id", "x_id", "y_id", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total_frags"))
    return SpatialDataset(spots, bins, counts, meta={"sample": sample, "grid": str(side)})
