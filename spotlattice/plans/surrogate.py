"""The driver's tables in genomic roles, so that every operator can run on them: fragments from line items, a 10 by 10
grid, and bins of 10 Mb. All formulas are on integers, so that other engines get the same rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.functions.genome import build_bins
from spotlattice.functions.reuse import reused
from spotlattice.operators import barcodes as B
from spotlattice.operators import clones, copynumber, neighbors, normalize, qc
from spotlattice.operators.reads import LINKER
from spotlattice.sources.fragments import from_pipeline

GRID, BIN = 10, 10_000_000
DNA = "translate(md5(cast({} as string)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


class Surrogate:
    """Frames of one folder; each is built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def bins(self) -> DataFrame:
        b = build_bins(self.spark, BIN)
        return b.selectExpr("*", "0.30D + cast((bin_id * 37) % 101 as double) / 303 as gc", "0.40D + cast((bin_id * 53) % 97 as double) / 161 as mappability", "if(bin_id % 29 = 0, 0.5D, 0.0D) as blacklist")

    @cached_property
    def fragments(self) -> DataFrame:
        li = self.table("lineitem").selectExpr(
            "cast(l_suppkey % 10 + 1 as int) as x",
            "cast((l_orderkey div 7) % 10 + 1 as int) as y",
            "cast((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709) % 316 as int) as bin_id",
            "(l_partkey * 1009) % 9000000 as o",
            "l_linenumber",
            "l_suppkey",
        )
        df = li.join(F.broadcast(self.bins.select("bin_id", "chr", "start")), "bin_id")
        df = df.where("not (chr = 'chr8' and l_linenumber % 2 = 1 and (2 * x - 11) * (2 * x - 11) + (2 * y - 11) * (2 * y - 11) < 40.96D)")
        return df.selectExpr("chr", "start + o as start", "start + o + 100 + l_linenumber as end", "concat('BC', x, 'X', y) as cb", "cast(30 + l_linenumber as int) as mapq", "l_suppkey")

    @cached_property
    def matched(self) -> DataFrame:
        xy = self.spark.range(100).selectExpr("cast(id div 10 + 1 as int) as x", "cast(id % 10 + 1 as int) as y")
        return xy.selectExpr("concat('BC', x, 'X', y) as barcode_obs", "if(x = 10 and y = 10, 'unmapped', 'mapped') as full_status", "if(x = 9 and y = 9, 11, x) as x_id", "y as y_id")

    @cached_property
    def dataset(self):
        return from_pipeline(self.fragments, self.matched, bin_size=BIN, grid=GRID)

    @cached_property
    def counts(self) -> DataFrame:
        return reused(self.dataset.counts)

    @cached_property
    def spots(self) -> DataFrame:
        return reused(self.dataset.spots)

    @cached_property
    def qc_bins(self) -> DataFrame:
        return qc.bin_qc(self.counts, self.spots, self.bins)

    @cached_property
    def corrected(self) -> DataFrame:
        return reused(qc.correct_bias(self.counts, self.bins))

    @cached_property
    def relative(self) -> DataFrame:
        return normalize.normalize(self.corrected, self.spots, self.qc_bins, extent=GRID)

    @cached_property
    def log2(self) -> DataFrame:
        return reused(copynumber.log2_ratio(self.relative, self.spots, self.qc_bins))

    @cached_property
    def smoothed(self) -> clones.Smoothed:
        return clones.dual_smooth(self.relative, self.spots, self.qc_bins, k_pc=10, k_xy=10, k_join=5, extent=GRID)

    @cached_property
    def cn(self) -> DataFrame:
        return reused(copynumber.copy_number(self.corrected, self.spots, self.qc_bins, extent=GRID))

    @cached_property
    def burden(self) -> DataFrame:
        return self.spots.join(copynumber.cnv_burden(self.cn), ["sample", "spot_id"])

    @cached_property
    def clone_labels(self) -> DataFrame:
        """Clusters by place: the disc of the planted loss, the rest by side."""
        disc = "(2 * x_id - 11) * (2 * x_id - 11) + (2 * y_id - 11) * (2 * y_id - 11) < 40.96D"
        return self.spots.selectExpr("*", f"case when {disc} then 1 when x_id <= 5 then 0 else 2 end as cluster")

    @cached_property
    def cohort(self) -> tuple[DataFrame, DataFrame]:
        """A simple layer of five samples, one for each region: counts of spots of 5 by 5 over their mean."""
        place = self.table("supplier").join(F.broadcast(self.table("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("sample"))
        df = self.fragments.join(place, "l_suppkey").selectExpr("sample", "chr", "(start + end) div 2 as mid", "start % 25 as s")
        offs = self.bins.groupBy("chr").agg(F.min("bin_id").alias("off"))
        df = df.join(F.broadcast(offs), "chr").selectExpr("sample", "cast(s as int) as spot_id", f"cast(off + mid div {BIN} as int) as bin_id")
        counts = df.groupBy("sample", "spot_id", "bin_id").agg(F.count("*").cast("double").alias("value"))
        spots = counts.groupBy("sample", "spot_id").agg(F.sum("value").alias("total_frags"))
        cells = spots.select("sample", "spot_id").join(self.bins.select("bin_id"))
        layer = cells.join(counts, ["sample", "spot_id", "bin_id"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)) + F.lit(0.5))
        return layer, spots

    @cached_property
    def profile(self) -> DataFrame:
        return self.cn.groupBy("sample", "bin_id").agg(F.median("value").alias("value"))

    @cached_property
    def x_refs(self) -> DataFrame:
        return self._refs(0)

    @cached_property
    def y_refs(self) -> DataFrame:
        return self._refs(1000)

    def _refs(self, base: int) -> DataFrame:
        codes = self.spark.range(1, 193).selectExpr("cast(id as int) as ref_index", f"substring({DNA.format(f'id + {base}')}, 1, 8) as code")
        return codes.groupBy("code").agg(F.min("ref_index").alias("ref_index"))

    @cached_property
    def observed(self) -> DataFrame:
        """barcode, fragments: pairs of reference codes, some with a wrong base, an N, a missing base, or made up."""
        x, y = DNA.format("l_suppkey % 192 + 1"), DNA.format("l_partkey % 192 + 1001")
        li = self.table("lineitem").selectExpr("l_orderkey", "l_linenumber % 6 as k", f"substring({x}, 1, 8) as x", f"substring({y}, 1, 8) as y", "cast(l_orderkey % 8 as int) as p")
        code = """case k when 1 then concat(substring(x, 1, p), 'T', substring(x, p + 2), y) when 2 then concat(x, substring(y, 1, p), 'N', substring(y, p + 2))
            when 3 then substring(concat(x, y), 1, 15) when 4 then substring(translate(md5(cast(l_orderkey as string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 16) else lower(concat(x, y)) end"""
        return li.selectExpr(f"{code} as barcode").groupBy("barcode").agg(F.count("*").alias("fragments"))

    @cached_property
    def x_axis(self) -> DataFrame:
        return B.fixed_axis(self.x_refs, B.X_SELECTED)

    @cached_property
    def y_axis(self) -> DataFrame:
        return B.fixed_axis(self.y_refs, B.Y_SELECTED)

    @cached_property
    def matches(self) -> DataFrame:
        return B.match_spots(self.observed, self.x_refs, self.y_refs, self.x_axis, self.y_axis)

    @cached_property
    def pairs(self) -> DataFrame:
        """Read pairs: a prefix of 0 to 2 bases, a code, the linker with 0 to 2 wrong bases, a code, and a tail."""
        tail = "concat({}, {}, {}, {})".format(*[DNA.format(f"o_orderkey + {i}") for i in (3, 4, 5, 6)])
        link = f"case o_orderkey % 7 when 0 then concat('G', substring('{LINKER}', 2)) when 1 then concat('GG', substring('{LINKER}', 3)) else '{LINKER}' end"
        s1 = f"concat(substring('AC', 1, cast(o_orderkey % 3 as int)), substring({DNA.format('o_custkey % 40')}, 1, 8), {link}, substring({DNA.format('o_custkey % 40 + 1')}, 1, 8), substring({tail}, 1, case o_orderkey % 11 when 0 then 90 when 1 then 4 else 120 end))"
        base = self.table("orders").selectExpr("o_orderkey", f"if(o_orderkey % 13 = 0, 'ACGTACGTAC', {s1}) as s1", f"{DNA.format('o_orderkey + 9')} as s2")
        return base.selectExpr("o_orderkey as ord", "concat('@r', o_orderkey, '/1 lane') as h1", "s1", "repeat('I', length(s1)) as q1", "concat('@r', o_orderkey, '/2 lane') as h2", "s2", "repeat('I', length(s2)) as q2")

    @cached_property
    def sam(self) -> DataFrame:
        name = "if(l_partkey % 17 = 0, concat('r', l_orderkey), concat('r', l_orderkey, '_CB=', substring({}, 1, 8), ':1'))".format(DNA.format("l_suppkey % 50"))
        return self.table("lineitem").selectExpr(
            f"{name} as qname",
            "case l_linenumber % 4 when 0 then 99 when 1 then 83 when 2 then 147 else 1123 end as flag",
            "concat('chr', l_suppkey % 22 + 1) as chr",
            "(l_orderkey * 7919 + l_partkey * 31) % 50000000 + 1 as pos",
            "cast(l_partkey % 60 as int) as mapq",
            "if(l_linenumber % 2 = 0, 1, -1) * (l_orderkey % 1300) as tlen",
        )

    @cached_property
    def peaks(self) -> DataFrame:
        return self.spark.range(1, 23).selectExpr("concat('chr', id) as chr", "explode(sequence(0L, 99L)) as k").selectExpr("chr", "k * 500000 + 1000 as start", "k * 500000 + 1000 + 20000 + k * 100 as end")

    @cached_property
    def gtf(self) -> DataFrame:
        return self.table("part").selectExpr("concat('chr', p_partkey % 22 + 1) as chr", "if(p_size % 5 = 0, 'exon', 'transcript') as feature", "(p_partkey * 7717) % 50000000 + 1 as start", "(p_partkey * 7717) % 50000000 + 900 as end", "if(p_size % 2 = 0, '+', if(p_size % 3 = 0, '-', '.')) as strand")

    @cached_property
    def expression(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Genes from part sizes, values from line items; the clones by place, the cell types by spot."""
        cells = self.spots.selectExpr("spot_id", "x_id", "y_id", "case when (x_id * 3 + y_id) % 4 = 0 then 'Tumor' when (x_id + y_id * 2) % 5 = 0 then 'Immune' else 'Stroma' end as cell_type")
        clones = self.clone_labels.selectExpr("spot_id", "x_id", "y_id", "concat('c', cluster) as clone")
        li = self.table("lineitem").selectExpr("concat('g', l_partkey % 20) as gene", "cast((l_suppkey % 10) * 10 + (l_orderkey div 7) % 10 as int) as spot_id", "l_quantity")
        sums = li.groupBy("gene", "spot_id").agg(F.sum("l_quantity").alias("value"))
        genes = self.spark.range(20).selectExpr("concat('g', id) as gene")
        expr = genes.join(cells.select("spot_id")).join(sums, ["gene", "spot_id"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
        return expr, clones, cells

    @cached_property
    def knn10(self) -> DataFrame:
        return neighbors.knn_xy(self.spots, 10, GRID)
