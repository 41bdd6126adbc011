"""Streams of fragments: the count matrix as a running aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spotlattice.dataset import SCHEMAS
from spotlattice.sources.fragments import counts_of, place_fragments


def read_fragment_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Fragment files as they appear in a folder."""
    reader = spark.readStream.schema(SCHEMAS["fragments"]).option("sep", "\t").option("mode", "DROPMALFORMED")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).csv(path)


def counts_from_stream(fragments: DataFrame, matched: DataFrame, **options) -> DataFrame:
    """The count of each spot and bin over a stream of fragments. Counts add up and their keys are bounded by the chip and
    the genome, so the state needs no watermark, and update or complete mode give the table of a batch run."""
    return counts_of(place_fragments(fragments, matched, **options))
