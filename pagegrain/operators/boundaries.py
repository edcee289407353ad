"""Header and footer candidates and the boundaries they agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.functions.scalar import is_blank
from pagegrain.operators.spacing import PAGE, base_spacing, classified, on_page
from pagegrain.params import DEFAULTS, LayoutParams


def zoned(lines: DataFrame, params: LayoutParams = DEFAULTS) -> DataFrame:
    """Lines with their neighbours and whether they are in the top or bottom
    zone; the bottom zone goes by the height of the document's first page."""
    heights = lines.groupBy("doc_id").agg(F.min_by("page_height", F.struct("page", "line_number")).alias("_height"))
    w = on_page()
    near = lines.select("*", F.lead("top").over(w).alias("next_top"), F.lag("bottom").over(w).alias("previous_bottom"))
    return near.join(heights, "doc_id").select(
        *near.columns, (F.col("top") < params.header_zone).alias("in_header"), (F.col("bottom") > F.coalesce("_height", F.lit(params.default_page_height)) - params.footer_zone).alias("in_footer"),
    )


def valid_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~is_blank(F.col("text")) & F.col("top").isNotNull() & (F.col("bottom") > F.col("top")))


def traditional(lines: DataFrame, params: LayoutParams = DEFAULTS) -> DataFrame:
    """Candidates whose raw gap towards the body is large against the page's
    base spacing. A page without positive gaps has base 0, so all pass."""
    base = base_spacing(lines)
    rows = zoned(lines, params).join(base, list(PAGE), "left").withColumn("least", F.coalesce("base", F.lit(0.0)) * params.large_gap_multiplier)
    down, up = F.col("next_top") - F.col("bottom"), F.col("top") - F.col("previous_bottom")
    header = rows.where(F.col("in_header") & (down >= F.col("least"))).select(*PAGE, F.lit("header").alias("target"), F.col("bottom").alias("y_coord"), "text", down.alias("gap"))
    footer = rows.where(F.col("in_footer") & (up >= F.col("least"))).select(*PAGE, F.lit("footer").alias("target"), F.col("top").alias("y_coord"), "text", up.alias("gap"))
    return header.unionByName(footer).withColumn("method", F.lit("traditional"))


def contextual(lines: DataFrame, rules: DataFrame, params: LayoutParams = DEFAULTS) -> DataFrame:
    """Candidates whose stored gap towards the body is a section gap."""
    rows = zoned(lines, params)
    header = classified(rows.where("in_header AND next_top IS NOT NULL"), rules, "gap_after", params).where("gap_type = 'Section'")
    footer = classified(rows.where("in_footer AND previous_bottom IS NOT NULL"), rules, "gap_before", params).where("gap_type = 'Section'")
    return (
        header.select(*PAGE, F.lit("header").alias("target"), F.col("bottom").alias("y_coord"), "text", F.col("gap_after").alias("gap"))
        .unionByName(footer.select(*PAGE, F.lit("footer").alias("target"), F.col("top").alias("y_coord"), "text", F.col("gap_before").alias("gap")))
        .withColumn("method", F.lit("contextual"))
    )


def final_boundaries(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, method, final_header_bottom, final_footer_top): the commonest
    position of each kind; 0 and the lowest text where there is none. Among
    equals the first page's counts, and on it the one nearest the page's edge."""
    counted = candidates.groupBy("doc_id", "method", "target", "y_coord").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("at"))
    mode = counted.groupBy("doc_id", "method").agg(*[
        F.max_by(F.when(F.col("target") == t, F.col("y_coord")), F.when(F.col("target") == t, F.struct("n", -F.col("at"), -F.col("y_coord")))).alias(t) for t in ("header", "footer")
    ])
    methods = F.explode(F.array(F.lit("traditional"), F.lit("contextual"))).alias("method")
    every = lines.groupBy("doc_id").agg(F.max("bottom").alias("lowest")).select("doc_id", "lowest", methods)
    return every.join(mode, ["doc_id", "method"], "left").select("doc_id", "method", F.coalesce("header", F.lit(0.0)).alias("final_header_bottom"), F.coalesce("footer", "lowest").alias("final_footer_top"))


def scanned(lines: DataFrame, params: LayoutParams = DEFAULTS) -> DataFrame:
    """Block scan from either edge of each page: gaps under the small limit go
    on, one of the large limit stops, gaps between set a candidate and go on,
    and leaving the zone ends the scan. (doc_id, page, header_bottom, footer_top),
    null where nothing was found. A fold over the page's lines, in order."""
    base = base_spacing(lines)
    page = lines.where(~is_blank(F.col("text"))).groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(F.struct("line_number", "top", "bottom"))).alias("l"), F.max("page_height").alias("height")
    ).join(base, list(PAGE))
    small, large = params.small_gap_multiplier, params.large_gap_multiplier
    fold = (
        "aggregate(sequence(0, size(l) - 1), struct(CAST(NULL AS DOUBLE) AS found, false AS done), (s, i) -> CASE "
        "WHEN s.done OR NOT ({zone}) THEN struct(s.found AS found, true AS done) "
        "WHEN {gap} IS NULL THEN struct(s.found AS found, true AS done) "
        f"WHEN {{gap}} >= {large}D * base THEN struct({{edge}} AS found, true AS done) "
        f"WHEN {{gap}} < {small}D * base THEN s "
        "ELSE struct({edge} AS found, false AS done) END).found"
    )
    header = fold.format(zone=f"l[i].top < {params.header_zone}D", gap="(get(l, i + 1).top - l[i].bottom)", edge="l[i].bottom")
    back = "l[size(l) - 1 - i]"
    footer = fold.format(zone=f"{back}.bottom > height - {params.footer_zone}D", gap=f"({back}.top - get(l, size(l) - 2 - i).bottom)", edge=f"{back}.top")
    return page.select(*PAGE, F.expr(header).alias("header_bottom"), F.expr(footer).alias("footer_top"))
