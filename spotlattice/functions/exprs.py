"""Scalar expressions with the reference semantics that Spark's own do not have."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float | None, hi: float | None) -> Column:
    """Null stays null, which greatest() and least() alone would not keep."""
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def log2_floor(x: Column, floor: float = 1e-3) -> Column:
    return F.log2(clip(x, floor, None))


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles, null where b is zero or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def half_even(x: Column) -> Column:
    return F.rint(x)


def hamming(a: Column, b: Column) -> Column:
    """Mismatches of two strings of equal length; null if the lengths differ."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(differ, F.lit(0), lambda s, v: s + v))


def parse_index_ranges(spec: str) -> list[int]:
    """'49-74,121-144' -> the indices; a reversed range or a repeated index is an error."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        lo, _, hi = part.partition("-")
        first, last = int(lo), int(hi or lo)
        if last < first:
            raise ValueError(f"reversed range {part!r}")
        out.extend(range(first, last + 1))
    if len(set(out)) != len(out):
        raise ValueError("an index occurs twice")
    return out


def parse_region(region: str) -> tuple[str, int | None, int | None]:
    """'chr8' or 'chr8:120-145' (Mb) -> (chromosome, first, last base, the last exclusive)."""
    m = re.fullmatch(r"(\w+)(?::([\d.]+)-([\d.]+))?", region)
    if not m:
        raise ValueError(f"not a region: {region!r}")
    return m[1], m[2] and int(float(m[2]) * 1_000_000), m[3] and int(float(m[3]) * 1_000_000)


def in_region(region: str) -> Column:
    """Of columns chr and start. The documented range form works here (the library it follows never reaches it)."""
    chrom, lo, hi = parse_region(region)
    out = F.col("chr") == chrom
    return out if lo is None else out & (F.col("start") >= lo) & (F.col("start") < hi)


#: The blocks of loading positions, in the order in which they stand in the device, as (first, last).
DEVICE_BLOCKS = ((1, 4), (47, 50), (5, 8), (43, 46), (9, 12), (39, 42), (13, 16), (35, 38), (17, 19), (32, 34), (20, 22), (29, 31), (23, 25), (26, 28))


def device_order() -> dict[int, int]:
    """Loading position -> true position, for 1 to 50: the blocks laid end to end."""
    return {p: i for i, p in enumerate((p for a, b in DEVICE_BLOCKS for p in range(a, b + 1)), 1)}
