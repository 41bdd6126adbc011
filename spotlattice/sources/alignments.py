"""Text readers for alignment records and gene annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str, comment: str, least: int) -> DataFrame:
    """The tab-separated fields ``p`` of lines that have at least so many and are no comments."""
    lines = spark.read.text(path).where(~F.col("value").startswith(comment))
    return lines.select(F.split("value", "\t").alias("p")).where(F.size("p") >= least)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, chr, pos (from 1), mapq, tlen of the records of a SAM file (.gz or not)."""
    p = F.col("p")
    return _fields(spark, path, "@", 11).select(p[0].alias("qname"), p[1].cast("int").alias("flag"), p[2].alias("chr"), p[3].cast("long").alias("pos"), p[4].cast("int").alias("mapq"), p[8].cast("long").alias("tlen"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """chr, feature, start (from 1), end, strand of the lines of a GTF or GFF file (.gz or not)."""
    p = F.col("p")
    return _fields(spark, path, "#", 8).select(p[0].alias("chr"), p[2].alias("feature"), p[3].cast("long").alias("start"), p[4].cast("long").alias("end"), p[6].alias("strand"))
