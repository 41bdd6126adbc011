"""From barcode counts to a section's tables: the second stage of the workflow, as tables and as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.functions.reuse import reused
from spotlattice.operators import barcodes as B
from spotlattice.sources.fragments import read_spot_fragments
from spotlattice.sources.sinks import write_fragments, write_tsv

SIDE = 50


def section_tables(spots: DataFrame, x_refs: DataFrame, y_refs: DataFrame, *, order: str = "XY", max_mm_x: int = 1, max_mm_y: int = 1, x_selected: str = B.X_SELECTED, y_selected: str = B.Y_SELECTED) -> dict[str, DataFrame]:
    """Every table of a section by the name of its file, from spots(barcode, fragments) and the two references."""
    x_axis, y_axis = B.fixed_axis(x_refs, x_selected), B.fixed_axis(y_refs, y_selected)
    matched = reused(B.match_spots(spots, x_refs, y_refs, x_axis, y_axis, order=order, max_mm_x=max_mm_x, max_mm_y=max_mm_y))
    cropped = reused(B.cropped_spots(matched))
    given = {"order": order, "max_mm_x": max_mm_x, "max_mm_y": max_mm_y, "x_ref_indices": x_selected, "y_ref_indices": y_selected}
    summary = B.mapping_summary(spots, matched, cropped).withColumns({"fixed_x_n": F.lit(SIDE), "fixed_y_n": F.lit(SIDE), **{k: F.lit(v) for k, v in given.items()}})
    return {
        "fixed_X_ref_index_to_X1_50_and_Xnew1_50": x_axis,
        "fixed_Y_ref_index_to_Y1_50_and_Ynew1_50": y_axis,
        "matched_spot_barcodes": matched,
        "mapped_spot_xy": matched.where("full_status = 'mapped'"),
        "top50_x": B.fixed_marginals(matched, x_axis, "x"),
        "top50_y": B.fixed_marginals(matched, y_axis, "y"),
        "all_matched_x_fragments": B.axis_marginals(matched, "x"),
        "all_matched_y_fragments": B.axis_marginals(matched, "y"),
        "top50x50_spot_fragments": cropped,
        "top50x50_matrix": B.spot_matrix(cropped),
        "top50x50_matrix_loading_X1Y1_order": B.spot_matrix(cropped, "X_order", "Y_order"),
        "summary": B.as_metrics(summary),
    }


def fragment_filter(lines: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines (value) of a fragment file whose barcode maps into the crop, and the (metric, value) lines about them."""
    inside = matched.where("full_status = 'mapped' and x_id is not null and y_id is not null")
    kept = reused(B.selected_fragments(lines, inside))
    total = lines.where(F.size(F.split("value", "\t")) >= 5).agg(F.count("*").alias("input_fragment_lines"))
    codes = inside.agg(F.countDistinct("barcode_obs").alias("selected_obs_barcodes"), F.countDistinct("barcode_mapped").alias("selected_mapped_barcodes"))
    one = total.join(kept.agg(F.count("*").alias("kept_fragments_lines"))).join(codes)
    return kept, B.as_metrics(one)


def map_section(spark: SparkSession, spot_fragments: str, x_ref: str, y_ref: str, out: str, fragments_with_cb: str | None = None, **options) -> dict[str, DataFrame]:
    """Read the inputs of a section, and write each of its tables, and the two fragment files, under ``out``.

    Every output is a folder of its name. Tables of a section are small and are one file each; fragments are not.
    """
    spots = reused(read_spot_fragments(spark, spot_fragments))
    x_refs, y_refs = (B.read_barcode_reference(spark, path, axis) for path, axis in ((x_ref, "X"), (y_ref, "Y")))
    tables = section_tables(spots, x_refs, y_refs, **options)
    if fragments_with_cb:
        kept, counts = fragment_filter(spark.read.text(fragments_with_cb), tables["matched_spot_barcodes"])
        write_fragments(kept, [f"{out}/{name}_fragments_with_cb.tsv.gz" for name in ("mapped", "top50x50")])
        tables["fragment_filter_summary"] = counts
    for name, df in tables.items():
        write_tsv(df, f"{out}/{name}.tsv", single=True)
    return tables
