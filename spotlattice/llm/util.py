"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: What ``stored`` has written in this process and nobody has discarded yet.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only where none is configured and everything runs in
    one process (tests); on a cluster a machine's own folder would lose data, so there it is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spotlattice-")
        sc.setCheckpointDir(base)
    return str(base).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Delete the intermediate tables and archives written so far, once the results that read them are used; how many."""
    gone, hadoop = 0, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(hadoop).delete(path, True))
    return gone


def sized_broadcast(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """df marked for a broadcast if it has no more than ``most`` rows; as it is, for a shuffle join, beyond that."""
    return F.broadcast(df) if rows <= most else df


def share_of_hash(seed: int, *keys: Column | str) -> Column:
    """A number from 0 up to 1 for each row, by a hash of its keys: below x for a share x of them, however small x is."""
    return F.xxhash64(F.lit(seed), *keys).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))


def release_memory() -> None:
    """Give what a Python worker has freed back to the system: workers live on beside the next stages of their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col, modulus: int):
    """crc32 of an id as text, modulo; null ids give null."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(modulus))


def n_words(col):
    """Number of words, 0 for null; in the JVM. The runs of white space before words are counted, on bytes: a regular
    expression would make objects for every word, and regexp_count an array of them all."""
    for space in "\t\n\x0b\x0c\r":
        col = F.replace(col, F.lit(space), F.lit(" "))
    runs = F.rtrim(F.concat(F.lit(" "), col))
    single = F.replace(F.replace(runs, F.lit(" "), F.lit("\t\n")), F.lit("\n\t"), F.lit(""))  # a tab and a newline for each run
    runs = F.when(F.contains(runs, F.lit("  ")), F.replace(single, F.lit("\t\n"), F.lit(" "))).otherwise(runs)
    return F.coalesce(F.octet_length(runs) - F.octet_length(F.replace(runs, F.lit(" "), F.lit(""))), F.lit(0)).cast("long")


def own_name(df: DataFrame, name: str) -> str:
    """A column name that does not clash with df's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
