"""FASTQ pairs and FASTA as Spark data sources, a partition for each file."""

from __future__ import annotations

import glob
import gzip
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _open(path: str):
    return gzip.open(path, "rt") if path.endswith(".gz") else open(path)


class _Files(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(p) for p in sorted(glob.glob(self.options["path"]))]


class FastqPairSource(DataSource):
    """format("fastq_pair"): options ``path`` (R1 files, a glob) and ``from``/``to``, which turn a name into its mate's.

    Stops at the first end of either mate; ``ord`` is the number of the pair in its file.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq_pair"

    def schema(self) -> str:
        return "file string, ord long, h1 string, s1 string, q1 string, h2 string, s2 string, q2 string"

    def reader(self, schema):
        return _FastqReader(self.options)


class _FastqReader(_Files):
    def read(self, partition) -> Iterator[tuple]:
        mate = partition.value.replace(self.options.get("from", "_R1"), self.options.get("to", "_R2"))
        record = lambda f: [f.readline().rstrip("\n") for _ in range(4)]
        with _open(partition.value) as a, _open(mate) as b:
            n = 0
            while True:
                one, two = record(a), record(b)
                if not one[0] or not two[0]:
                    return
                yield partition.value, n, one[0], one[1], one[3], two[0], two[1], two[3]
                n += 1


class FastaBinSource(DataSource):
    """format("fasta_bins"): options ``path`` and ``bin_size``; pieces (chr, bin, seq) of the sequences by bin."""

    @classmethod
    def name(cls) -> str:
        return "fasta_bins"

    def schema(self) -> str:
        return "chr string, bin long, seq string"

    def reader(self, schema):
        return _FastaReader(self.options)


class _FastaReader(_Files):
    def read(self, partition) -> Iterator[tuple]:
        size = int(self.options.get("bin_size", 1_000_000))
        chrom, at = None, 0
        with _open(partition.value) as f:
            for line in f:
                line = line.rstrip("\n")
                if line.startswith(">"):
                    chrom, at = (line[1:].split() or [""])[0], 0
                    continue
                while line and chrom is not None:
                    room = size - at % size
                    yield chrom, at // size, line[:room]
                    at += len(line[:room])
                    line = line[room:]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqPairSource)
    spark.dataSource.register(FastaBinSource)
