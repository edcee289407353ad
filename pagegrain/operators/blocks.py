"""Blocks of lines of one size and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.functions.scalar import is_blank
from pagegrain.operators.spacing import PAGE, on_page


def numbered_lines(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines with text and a size, and the number of the block each is in: a
    block goes on while the size stays, has rules, and the gap is a line gap."""
    known = rules.select("doc_id", F.col("context_size").alias("predominant_size"), "line_hi")
    rows = lines.where(~is_blank(F.col("text")) & F.col("predominant_size").isNotNull()).join(known, ["doc_id", "predominant_size"], "left")
    goes_on = F.coalesce((F.lag("predominant_size").over(on_page()) == F.col("predominant_size")) & (F.col("gap_before") <= F.col("line_hi")), F.lit(False))
    starts = rows.withColumn("_start", F.when(goes_on, 0).otherwise(1))
    return starts.withColumn("block_no", F.sum("_start").over(on_page()).cast("int")).drop("_start", "line_hi")


def blocks(numbered: DataFrame) -> DataFrame:
    """One row per block with its box, text and lines; fonts count by line."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("line_number", F.col(c).alias("v")))), lambda s: s["v"])
    keys = (*PAGE, "block_no")
    fonts = numbered.groupBy(*keys, "predominant_font").agg(F.count(F.lit(1)).alias("n"), F.min("line_number").alias("at"))
    font = fonts.groupBy(*keys).agg(F.max_by("predominant_font", F.struct("n", -F.col("at"))).alias("predominant_font"), (F.max("n") / F.sum("n")).alias("font_coverage"))
    body = numbered.groupBy(*keys).agg(
        F.first("predominant_size").alias("predominant_size"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"),
        ordered("text").alias("text_lines"), F.count(F.lit(1)).alias("n_lines"), F.min_by("gap_before", "line_number").alias("first_gap"), F.max_by("gap_before", "line_number").alias("last_gap"),
    )
    return body.join(font, list(keys)).withColumn("text", F.array_join("text_lines", "\n"))


def segment_metadata(numbered: DataFrame, segs: DataFrame) -> DataFrame:
    """Size and font that most segments of a block have, and the shares of its
    segments that have them; the first to appear among equals."""
    keys = (*PAGE, "block_no")
    rows = segs.join(numbered.select(*keys, "line_number"), [*PAGE, "line_number"]).select(*keys, "line_number", "seg_no", "rounded_size", "font")
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    for name, column in (("size", "rounded_size"), ("font", "font")):
        counted = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_number", "seg_no")).alias("at"))
        best = counted.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("n"), F.col("at"))).alias(f"predominant_{name}"), F.max("n").alias(f"_{name}"))
        out = out.join(best, list(keys), "left").withColumn(f"{name}_coverage", F.col(f"_{name}") / F.col("_n"))
    return out.drop("_n", "_size", "_font")


def with_block_gaps(found: DataFrame) -> DataFrame:
    """Adds gap_before and gap_after between boxes, which may be negative. A
    page's first block keeps its line's gap; its last keeps the gap before its
    last line, or 0 if it has only one."""
    w = Window.partitionBy(*PAGE).orderBy("block_no")
    before = F.coalesce(F.col("top") - F.lag("bottom").over(w), F.col("first_gap"))
    after = F.coalesce(F.lead("top").over(w) - F.col("bottom"), F.when(F.col("n_lines") > 1, F.col("last_gap")).otherwise(F.lit(0.0)))
    return found.select("*", before.alias("gap_before"), after.alias("gap_after"))


def streamlined(found: DataFrame) -> DataFrame:
    """The five fields that a prompt needs: stripped lines, position and font."""
    lines = F.filter(F.transform("text_lines", lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != "")
    return found.select(*PAGE, "block_no", lines.alias("text_lines"), F.col("top").alias("y0"), "x0", F.col("predominant_font").alias("font_name"), F.col("predominant_size").alias("font_size")).where(F.size("text_lines") > 0)


def pages_json(found: DataFrame) -> DataFrame:
    """Blocks nested by page, in order, as they are handed on in JSON."""
    block = F.struct("block_no", "predominant_size", "predominant_font", "text", "n_lines")
    return found.groupBy(*PAGE).agg(F.to_json(F.array_sort(F.collect_list(block))).alias("blocks"))
