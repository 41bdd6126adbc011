"""Exact positions in a global order without a global sort in one task.

Rows are dealt into buckets that follow the order; the bucket totals (a bounded table) give each bucket's offset, and a
window inside each bucket gives the rest. Group keys must not be null: see ``group_key``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotlattice.llm.util import sized_broadcast, stored


def group_key(col: Column) -> Column:
    """A string that sorts as the column does by code point, null last, and is never null."""
    return F.concat(F.when(col.isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(col.cast("string"), F.lit("")))


def n_buckets(rows: int, each: int = 1000, most: int = 1 << 16) -> int:
    """A power of two, so that a bucket holds about ``each`` rows, up to ``most`` buckets."""
    k = 1
    while k < most and k * each < rows:
        k *= 2
    return k


def prefix_sums(df: DataFrame, group: str | None, bucket: Column, order: list[str], sums: dict[str, Column], slim: DataFrame | None = None) -> DataFrame:
    """df with, for each name in ``sums``, the sum of its column over the rows before this one in its group's order.

    ``bucket`` must not decrease along the order. Ties in ``order`` are put in some order. Only the totals of the buckets
    meet in one task for each group, and their number is bounded. ``slim`` may be the same rows, with the columns that
    group, bucket and sums need and are dearer to compute from df.
    """
    names = list(sums)
    group = group or "__g"

    def prepared(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("__g", F.lit("")) if group == "__g" else rows
        return rows.withColumn("__b", bucket.cast("int")).withColumns({f"__v_{n}": sums[n] for n in names})

    df, slim = prepared(df), prepared(slim or df)
    totals = slim.groupBy(group, "__b").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    before = W.partitionBy(group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(group, "__b", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in names])
    inner = W.partitionBy(group, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.join(offsets, [group, "__b"])
    out = out.withColumns({n: F.col(f"__o_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inner), F.lit(0)) for n in names})
    return out.drop("__g", "__b", *[f"__{k}_{n}" for n in names for k in "vo"])


class Steps(NamedTuple):
    """Ranges of a whole-number key: equal steps between its ends, of which the heavy ones are cut again (see ``steps``)."""

    key: str
    lo: int
    width: int
    n: int
    cuts: list[tuple[DataFrame, int]]  #: for each further level the heavy steps (__b, __lo, __w), and their number

    def of(self, df: DataFrame) -> DataFrame:
        """df with ``__b``, the number of the step that its key falls into: it does not decrease with the key; null is first."""
        key = F.col(self.key).cast("decimal(20,0)")
        df = df.withColumn("__b", F.coalesce(F.floor((key - F.lit(self.lo).cast("decimal(20,0)")) / F.lit(self.width).cast("decimal(20,0)")), F.lit(-1)).cast("long"))
        for cut, n in self.cuts:
            df = df.join(sized_broadcast(cut, n), "__b", "left")
            inner = F.coalesce(F.floor((key - F.col("__lo").cast("decimal(20,0)")) / F.col("__w").cast("decimal(20,0)")), F.lit(0)).cast("long")
            df = df.withColumn("__b", F.col("__b") * F.lit(1 << _CUT_BITS) + inner).drop("__lo", "__w")
        return df

    def bucket(self, most: int = 1 << 16) -> Column:
        """A coarse number from 0 up to ``most`` that does not decrease with ``__b``."""
        first = F.greatest(F.floor(F.col("__b") / F.lit(float(1 << (_CUT_BITS * len(self.cuts))))), F.lit(0))
        return F.floor(first * F.lit(min(most, self.n)) / F.lit(self.n)).cast("int")


_CUT_BITS = 20


def steps(slim: DataFrame, key: str, each: int, weight: Column | None = None, *, levels: int = 2, most: int = 1 << 22) -> Steps:
    """Steps of ``key`` that weigh about ``each`` (rows, unless a weight is given).

    They are equal at first. Those that weigh four times as much and have several keys are cut into equal steps between
    their own smallest and largest key, up to ``levels`` times, so that a few keys far away from all others do no harm.
    The same rows always give the same steps. ``slim`` is read several times and should be a stored table.
    """
    slim = slim.select(key, (F.lit(1) if weight is None else weight).cast("long").alias("w")).where(F.col(key).isNotNull())
    lo, hi, total = slim.agg(F.min(key), F.max(key), F.sum("w")).first()
    lo, hi, total = (0, 0, 0) if lo is None else (int(lo), int(hi), int(total))
    n = n_buckets(total, each, most)
    found = Steps(key, lo, (hi - lo) // n + 1, n, [])
    for _ in range(levels):
        by = found.of(slim).groupBy("__b").agg(F.sum("w").alias("w"), F.min(key).alias("__lo"), F.max(key).alias("__hi")).where((F.col("w") > 4 * each) & (F.col("__hi") > F.col("__lo")))
        parts = F.least(F.ceil(F.col("w") / F.lit(each)), F.lit(1 << _CUT_BITS)).cast("decimal(20,0)")
        span = F.col("__hi").cast("decimal(20,0)") - F.col("__lo").cast("decimal(20,0)")
        heavy = stored(by.select("__b", F.col("__lo").cast("long").alias("__lo"), (F.floor(span / parts) + 1).cast("decimal(20,0)").alias("__w")), "heavy")
        n_heavy = heavy.count()
        if not n_heavy:
            break
        found.cuts.append((heavy, n_heavy))
    return found
