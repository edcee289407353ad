"""Gap histograms, spacing rules by font size, gap classes and paragraph gaps.

Lines: doc_id, page, line_number, text, predominant_size, top, bottom and the
gap columns that ``with_gaps`` adds. Ties of every mode go to the value that
appears first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.functions.scalar import is_blank, round_to
from pagegrain.params import DEFAULTS, LayoutParams

PAGE = ("doc_id", "page")

#: Line gaps that a gap between paragraphs exceeds.
PARAGRAPH_GAP = 1.3


def on_page() -> Window:
    return Window.partitionBy(*PAGE).orderBy("line_number")


def in_document(keys: Sequence[str] = ("doc_id",)) -> Window:
    order = ["line_number"] if "page" in keys else ["page", "line_number"]
    return Window.partitionBy(*keys).orderBy(*order)


def with_gaps(lines: DataFrame) -> DataFrame:
    """Adds gap_before and gap_after, never below zero: to the neighbour on the
    page, to the page's top and to its bottom edge."""
    w = on_page()
    above, below = F.lag("bottom").over(w), F.lead("top").over(w)
    first, last = F.row_number().over(w) == 1, F.lead("line_number").over(w).isNull()
    zero = F.lit(0.0)
    return lines.select(
        "*", F.when(first, F.col("top")).when(above.isNotNull() & F.col("top").isNotNull(), F.greatest(F.col("top") - above, zero)).alias("gap_before"),
        F.when(last, F.col("page_height") - F.col("bottom")).when(below.isNotNull() & F.col("bottom").isNotNull(), F.greatest(below - F.col("bottom"), zero)).alias("gap_after"),
    )


def drop_blank(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, numbered anew; the old number is kept and gaps
    are those to the nearest lines that are left."""
    kept = lines.drop("gap_before", "gap_after").where(~is_blank(F.col("text"))).withColumnRenamed("line_number", "original_line_number")
    w = Window.partitionBy(*PAGE).orderBy("original_line_number")
    return with_gaps(kept.withColumn("line_number", F.row_number().over(w)))


def gap_samples(lines: DataFrame, params: LayoutParams = DEFAULTS, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, context_size, gap, pos): rounded gaps between neighbouring lines of
    one size. By document the neighbour may stand on the page before."""
    w = in_document(keys)
    rows = lines.select(*keys, "line_number", *([] if "page" in keys else ["page"]), "predominant_size", "gap_before", F.row_number().over(w).alias("pos"), F.lag("predominant_size").over(w).alias("previous"))
    same = (F.col("predominant_size") == F.col("previous")) & (F.col("gap_before") > 0.01)
    return rows.where(same).select(*keys, F.col("predominant_size").alias("context_size"), round_to(F.col("gap_before"), params.gap_rounding).alias("gap"), "pos")


def gap_histogram(samples: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    return samples.groupBy(*keys, "context_size", "gap").agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first_pos"))


def lines_per_size(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("predominant_size").isNotNull()).groupBy("doc_id", F.col("predominant_size").alias("context_size")).agg(F.count(F.lit(1)).alias("n_lines"))


def spacing_rules(histogram: DataFrame, params: LayoutParams = DEFAULTS, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per context size: the modal gap, the band of line gaps around it,
    the largest paragraph gap, and the gaps up to the band's end, from there to
    the largest paragraph gap, and over that one."""
    tolerance = params.line_spacing_tolerance
    modal = histogram.groupBy(*keys, "context_size").agg(F.max_by("gap", F.struct("cnt", -F.col("first_pos"))).alias("most_common_gap"), F.sum("cnt").alias("total_gaps"), F.min("first_pos").alias("first_pos"))
    rules = modal.select(
        *keys, "context_size", "most_common_gap", (F.col("most_common_gap") * (1 - tolerance)).alias("line_lo"), (F.col("most_common_gap") * (1 + tolerance)).alias("line_hi"),
        (F.col("context_size") * params.para_spacing_multiplier).alias("para_max"), "total_gaps", "first_pos",
    )
    sized = histogram.select(*keys, "context_size", "gap", "cnt").join(rules, [*keys, "context_size"])
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("cnt"))), F.lit(0))
    line, most = F.col("gap") <= F.col("line_hi"), F.col("para_max")
    return sized.groupBy(*keys, "context_size", "most_common_gap", "line_lo", "line_hi", "para_max", "total_gaps", "first_pos").agg(
        part(line).alias("line_gaps"), part(~line & (F.col("gap") <= most)).alias("para_gaps"), part(F.col("gap") > most).alias("section_gaps"),
    )


def gap_class(gap: Column, line_hi: Column, para_max: Column, params: LayoutParams = DEFAULTS) -> Column:
    """Line, Paragraph or Section; Line where there are no rules."""
    g = round_to(gap, params.gap_rounding)
    return F.when(line_hi.isNull() | (g <= line_hi), "Line").when(g <= para_max, "Paragraph").otherwise("Section")


def classified(lines: DataFrame, rules: DataFrame, gap: str = "gap_before", params: LayoutParams = DEFAULTS, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Adds gap_type. A size without rules takes those of the size with most gaps."""
    own = rules.select(*keys, F.col("context_size").alias("predominant_size"), F.col("line_hi").alias("_hi"), F.col("para_max").alias("_max"))
    best = rules.groupBy(*keys).agg(F.max_by(F.struct("line_hi", "para_max"), F.struct("total_gaps", -F.col("first_pos"))).alias("_b"))
    joined = lines.join(own, [*keys, "predominant_size"], "left").join(best, list(keys), "left")
    hi, most = F.coalesce("_hi", "_b.line_hi"), F.coalesce("_max", "_b.para_max")
    return joined.withColumn("gap_type", gap_class(F.col(gap), hi, most, params)).drop("_hi", "_max", "_b")


def line_spacing(lines: DataFrame, params: LayoutParams = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(histogram of positive gaps, the most common one over 0.01 per document)."""
    w = in_document()
    seen = lines.select("doc_id", "gap_before", F.row_number().over(w).alias("pos")).where("gap_before > 0")
    histogram = seen.groupBy("doc_id", round_to(F.col("gap_before"), params.round_to_nearest_pt).alias("gap")).agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first_pos"))
    top = F.max_by("gap", F.struct((F.col("gap") > 0.01).alias("real"), "cnt", -F.col("first_pos")))
    return histogram, histogram.groupBy("doc_id").agg(top.alias("most_common_gap"))


def paragraph_candidates(histogram: DataFrame, common: DataFrame, params: LayoutParams = DEFAULTS) -> DataFrame:
    """Gaps that may part paragraphs: over 1.3 line gaps, whatever the profile,
    and under 1.5 large ones."""
    low, high = F.col("most_common_gap") * PARAGRAPH_GAP, F.col("most_common_gap") * params.large_gap_multiplier * 1.5
    return histogram.join(common, "doc_id").where((F.col("gap") > low) & (F.col("gap") < high)).select("doc_id", "gap", "cnt")


def paragraph_spacing(lines: DataFrame, params: LayoutParams = DEFAULTS) -> DataFrame:
    """Paragraph and section gaps per document, counted and averaged by the
    rules of each page; a page's first line does not count."""
    rules = spacing_rules(gap_histogram(gap_samples(lines, params, PAGE), PAGE), params, PAGE)
    first = F.row_number().over(on_page()) == 1
    rest = lines.withColumn("_first", first).where(~F.col("_first") & (F.col("gap_before") > 0))
    told = classified(rest, rules, "gap_before", params, PAGE)
    of = lambda kind: F.when(F.col("gap_type") == kind, F.col("gap_before"))
    return told.groupBy("doc_id").agg(
        F.count(of("Paragraph")).alias("paragraph_gaps"), F.coalesce(F.avg(of("Paragraph")), F.lit(0.0)).alias("paragraph_avg"),
        F.count(of("Section")).alias("section_gaps"), F.coalesce(F.avg(of("Section")), F.lit(0.0)).alias("section_avg"),
    )


def base_spacing(lines: DataFrame) -> DataFrame:
    """The modal positive gap of each page, unrounded, one over 0.01 if any."""
    seen = lines.where("gap_before > 0").groupBy(*PAGE, "gap_before").agg(F.count(F.lit(1)).alias("cnt"), F.min("line_number").alias("first"))
    order = F.struct((F.col("gap_before") > 0.01).alias("real"), "cnt", -F.col("first"))
    return seen.groupBy(*PAGE).agg(F.max_by("gap_before", order).alias("base"))
