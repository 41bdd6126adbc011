"""Text sinks: tables and key-value summaries as TSV, FASTQ and fragment lines as gzip."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_tsv(df: DataFrame, path: str, *, single: bool = False, header: bool = True) -> None:
    """``single`` is for small tables that must be one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(df[column].alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def write_fragments(df: DataFrame, paths: list[str]) -> None:
    """The same gzip lines in each folder."""
    for path in paths:
        write_lines(df, path)
