"""Spatial barcodes: correction to a reference, mapping to the grid, marginals and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.functions.exprs import device_order, parse_index_ranges

LENGTH = 8
MASK = "*"
X_SELECTED, Y_SELECTED = "49-74,121-144", "49-70,73-78,123-144"


def read_barcode_reference(spark: SparkSession, path: str, axis: str) -> DataFrame:
    """ref_index, code from one code a line, or from a table with a header. Codes must be of 8 letters and distinct."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    head = lines.first()
    if head is not None and f"{axis}_barcode" in head[0]:
        names = head[0].split("\t")
        cols = F.split("value", "\t")
        rows = lines.where(F.col("value") != head[0]).select(cols[names.index(f"{axis}_barcode")].alias("code"), (cols[names.index(f"{axis}_ref_index")].cast("int") if f"{axis}_ref_index" in names else F.lit(None).cast("int")).alias("ref_index"))
    else:
        rows = lines.select(F.col("value").alias("code"), F.lit(None).cast("int").alias("ref_index"))
    got = [(r["ref_index"], r["code"].strip().upper()) for r in rows.collect()]  # a reference list: a few hundred codes
    codes = [c for _, c in got]
    if any(len(c) != LENGTH for c in codes):
        raise ValueError(f"a code of axis {axis} has not {LENGTH} letters")
    if len(set(codes)) != len(codes):
        raise ValueError(f"a code of axis {axis} occurs twice")
    return spark.createDataFrame([(i if n is None else n, c) for i, (n, c) in enumerate(got, 1)], "ref_index int, code string")


def variants(refs: DataFrame) -> DataFrame:
    """form, code, n_codes: every string one base off a code, and every code with one place masked; n_codes tells how many
    codes have the form. A few thousand rows."""
    spots = F.explode(F.sequence(F.lit(1), F.lit(LENGTH)))
    forms = F.explode(F.array(*map(F.lit, "ACGT"), F.lit(MASK)))
    each = refs.select("code", spots.alias("i")).select("code", "i", forms.alias("base")).where(F.substring("code", F.col("i"), F.lit(1)) != F.col("base"))
    made = each.select("code", F.overlay("code", "base", F.col("i"), F.lit(1)).alias("form"))
    return made.groupBy("form").agg(F.min("code").alias("code"), F.countDistinct("code").alias("n_codes"))


def _nearest(halves: DataFrame, refs: DataFrame, max_mm: int) -> DataFrame:
    """form, code, n_codes, mm of the distinct halves that have codes within max_mm: each is held against every code, once."""
    differ = lambda i: (F.substring("form", i, 1) != F.substring("code", i, 1)).cast("int")
    far = halves.join(F.broadcast(refs.select("code"))).withColumn("mm", sum((differ(i) for i in range(2, LENGTH + 1)), differ(1))).where(F.col("mm") <= max_mm)
    # How many codes there are at each distance, and the first of the nearest ones, in one pass.
    counts = [F.count_if(F.col("mm") == d).alias(f"c{d}") for d in range(max_mm + 1)]
    best = far.groupBy("form").agg(F.min(F.struct("mm", "code")).alias("b"), *counts)
    return best.select("form", "b.code", F.element_at(F.array(*[F.col(f"c{d}") for d in range(max_mm + 1)]), F.col("b.mm") + 1).alias("n_codes"), "b.mm")


def match_halves(queries: DataFrame, refs: DataFrame, column: str, max_mm: int = 1) -> DataFrame:
    """queries with status, match and mm of ``column``: exact, else the only code at the least distance up to max_mm.

    References are a few hundred codes, so they and their forms are broadcast: no shuffle of the queries. A letter other
    than ACGT is a mismatch by itself, so a half with one of them is looked up with that place masked, and one with more
    has no code at a distance of 1. Larger distances, and references with other letters, are compared with every code.
    """
    q = F.upper(F.trim(column))
    df = queries.withColumn("__q", q).join(F.broadcast(refs.select(F.col("code").alias("__exact"))), F.col("__q") == F.col("__exact"), "left")
    status = F.when(F.length("__q") != LENGTH, "bad_length").when(F.col("__exact").isNotNull(), "exact")
    if max_mm <= 0:
        return df.withColumns({"status": status.otherwise("unmapped"), "match": F.col("__exact"), "mm": F.when(F.col("__exact").isNotNull(), 0)}).drop("__q", "__exact")
    if max_mm == 1 and refs.where(~F.col("code").rlike("^[ACGT]+$")).isEmpty():
        table = F.broadcast(variants(refs).withColumn("mm", F.lit(1)))
        df = df.withColumn("form", F.regexp_replace("__q", "[^ACGT]", MASK))
    else:
        open_ = df.where(F.col("__exact").isNull() & (F.length("__q") == LENGTH)).select(F.col("__q").alias("form")).distinct()
        table = _nearest(open_, refs, max_mm)
        df = df.withColumn("form", F.col("__q"))
    hit = F.when(F.length("__q") == LENGTH, F.col("n_codes"))
    return df.join(table, "form", "left").withColumns(
        {
            "status": status.when(hit > 1, "ambiguous").when(hit == 1, "corrected").otherwise("unmapped"),
            "match": F.coalesce("__exact", F.when(hit == 1, F.col("code"))),
            "mm": F.when(F.col("__exact").isNotNull(), 0).when(hit >= 1, F.col("mm")),
        }
    ).drop("__q", "__exact", "form", "code", "n_codes")


def fixed_axis(refs: DataFrame, selected: str) -> DataFrame:
    """ref_index, code, load_order, true_order of the fifty selected codes."""
    wanted = parse_index_ranges(selected)
    true = device_order()
    if sorted(true.values()) != list(range(1, 51)) or len(wanted) != len(true):
        raise ValueError("the axis is not a permutation of 1 to 50")
    rows = [(r, i, true[i]) for i, r in enumerate(wanted, 1)]
    return refs.join(F.broadcast(refs.sparkSession.createDataFrame(rows, "ref_index int, load_order int, true_order int")), "ref_index")


def match_spots(spots: DataFrame, x_refs: DataFrame, y_refs: DataFrame, x_axis: DataFrame, y_axis: DataFrame, *, order: str = "XY", max_mm_x: int = 1, max_mm_y: int = 1) -> DataFrame:
    """spots(barcode, fragments) -> the table of matched barcodes. All references are matched first and the selected ones
    picked after, so that a barcode is not corrected to a selected code when another one is nearer."""
    bc = F.upper(F.trim("barcode"))
    df = spots.select(bc.alias("barcode_obs"), F.col("fragments").cast("long").alias("fragments")).withColumn("len", F.length("barcode_obs"))
    ok = F.col("len") == 2 * LENGTH
    first, second = F.when(ok, F.substring("barcode_obs", 1, LENGTH)), F.when(ok, F.substring("barcode_obs", LENGTH + 1, LENGTH))
    df = df.withColumns({"x_half_obs": first if order == "XY" else second, "y_half_obs": second if order == "XY" else first})
    for a, refs, axis, mm in (("x", x_refs, x_axis, max_mm_x), ("y", y_refs, y_axis, max_mm_y)):
        df = match_halves(df, refs, f"{a}_half_obs", mm).withColumnsRenamed({"status": f"{a}_status", "match": f"{a}_barcode", "mm": f"mm_{a}"})
        df = df.withColumn(f"{a}_status", F.when(ok, F.col(f"{a}_status")))
        place = refs.select(F.col("code").alias(f"{a}_barcode"), F.col("ref_index").alias(f"{a.upper()}_ref_index"))
        chosen = axis.select(F.col("code").alias(f"{a}_barcode"), F.col("load_order").alias(f"{a.upper()}_order"), F.col("true_order").alias(f"{a}_id"))
        df = df.join(F.broadcast(place), f"{a}_barcode", "left").join(F.broadcast(chosen), f"{a}_barcode", "left")
    good = lambda a: F.col(f"{a}_status").isin("exact", "corrected")
    either = lambda s: (F.col("x_status") == s) | (F.col("y_status") == s)
    full = F.when(~ok, "bad_length").when(good("x") & good("y"), "mapped").when(either("ambiguous"), "ambiguous").when(either("bad_length"), "bad_length").otherwise("unmapped")
    df = df.withColumn("full_status", full)
    mapped = F.col("full_status") == "mapped"
    joined = F.concat("x_barcode", "y_barcode") if order == "XY" else F.concat("y_barcode", "x_barcode")
    df = df.withColumn("barcode_mapped", F.when(mapped, joined))
    for c in ("X_ref_index", "Y_ref_index", "X_order", "Y_order", "x_id", "y_id"):
        df = df.withColumn(c, F.when(mapped, F.col(c)))
    more = {"Xnew_order": F.col("x_id"), "Ynew_order": F.col("y_id"), "x_rank": F.col("x_id"), "y_rank": F.col("y_id")}
    names = "barcode_obs fragments len x_half_obs y_half_obs x_status y_status x_barcode y_barcode mm_x mm_y full_status barcode_mapped X_ref_index Y_ref_index X_order Y_order Xnew_order Ynew_order x_id y_id x_rank y_rank"
    return df.withColumns(more).select(*names.split())


def axis_marginals(matched: DataFrame, axis: str) -> DataFrame:
    """Fragments of every reference code of an axis that has any, with its place if it is selected."""
    a = axis.lower()
    big = axis.upper()
    groups = matched.where("full_status = 'mapped'").groupBy(f"{a}_barcode", f"{big}_ref_index")
    return groups.agg(F.sum("fragments").alias("fragments"), F.max(f"{big}_order").alias(f"{big}_order"), F.max(f"{a}_id").alias(f"{a}_id"))


def fixed_marginals(matched: DataFrame, axis_table: DataFrame, axis: str) -> DataFrame:
    """Fragments of the fifty selected codes of an axis, zero for those without any."""
    a = axis.lower()
    sums = matched.where("full_status = 'mapped'").groupBy(F.col(f"{a}_barcode").alias("code")).agg(F.sum("fragments").alias("fragments"))
    return axis_table.join(sums, "code", "left").withColumn("fragments", F.coalesce("fragments", F.lit(0))).select("ref_index", "code", "load_order", F.col("true_order").alias(f"{a}_id"), "fragments")


def cropped_spots(matched: DataFrame) -> DataFrame:
    """Fragments of each pair of selected codes."""
    keys = ["barcode_mapped", "x_barcode", "y_barcode", "X_ref_index", "Y_ref_index", "X_order", "Y_order", "x_id", "y_id"]
    return matched.where("full_status = 'mapped' and x_id is not null and y_id is not null").groupBy(*keys).agg(F.sum("fragments").alias("fragments"))


def spot_matrix(cropped: DataFrame, row: str = "x_id", col: str = "y_id", side: int = 50) -> DataFrame:
    """The square of fragments, a row for each place and columns 1 to side, zeros filled in."""
    wide = cropped.groupBy(row).pivot(col, list(range(1, side + 1))).agg(F.sum("fragments"))
    every = cropped.sparkSession.range(1, side + 1).select(F.col("id").cast("int").alias(row))
    return every.join(wide, row, "left").fillna(0)


def mapping_summary(spots: DataFrame, matched: DataFrame, cropped: DataFrame) -> DataFrame:
    """One row of counts and means over the input, the mapped and the cropped barcodes."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    a = spots.agg(F.count("*").alias("total_spot_barcodes_input"), zero(F.sum("fragments")).alias("total_fragments_input"))
    m = matched.where("full_status = 'mapped'").agg(F.count("*").alias("mapped_spot_barcodes_all_refs"), zero(F.sum("fragments")).alias("mapped_fragments_all_refs"))
    c = cropped.agg(F.count("*").alias("cropped_spot_barcodes"), zero(F.sum("fragments")).alias("cropped_fragments"), F.coalesce(F.avg("fragments"), F.lit(0.0)).alias("mean_fragments_per_cropped_spot"), F.coalesce(F.median("fragments"), F.lit(0.0)).alias("median_fragments_per_cropped_spot"))
    return a.join(m).join(c)


def as_metrics(row: DataFrame) -> DataFrame:
    """A one-row table as (metric, value) lines."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns])
    return row.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")


def selected_fragments(lines: DataFrame, cropped: DataFrame) -> DataFrame:
    """The lines (value) of a fragment file, of five fields at least, whose barcode maps into the crop."""
    fields = F.split("value", "\t")
    df = lines.where(F.size(fields) >= 5).withColumn("cb", F.upper(F.trim(fields[3])))
    return df.join(cropped.select(F.upper("barcode_obs").alias("cb")).distinct(), "cb", "left_semi").select("value")
