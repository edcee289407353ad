"""Words to lines, segments and text; measures of a line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.functions.scalar import is_blank, round_to, strip
from pagegrain.params import DEFAULTS, LayoutParams

PAGE = ("doc_id", "page")
LINE = ("doc_id", "page", "line_number")


def grouped_lines(words: DataFrame, tolerance: float = DEFAULTS.y_tolerance, flow_order: bool = False) -> DataFrame:
    """Adds line_number. A line is anchored at the top of its first word: a word
    farther than ``tolerance`` from the anchor begins the next line. Words come
    by top, those of one top in flow order; or in flow order alone. The fold runs
    over a page's distinct positions as two parallel arrays; keys join back."""
    order = "word_seq" if flow_order else "top"
    entry = F.struct(F.col("word_seq").alias("a"), F.col("top").alias("top")) if flow_order else F.struct(F.col("top").alias("a"), F.col("top").alias("top"))
    spots = words.groupBy(*PAGE).agg(F.array_sort(F.collect_set(entry)).alias("s"))
    # only the words that begin a line are kept, so the state stays as small as the page has lines
    starts = F.expr(
        "aggregate(s, CAST(array() AS array<struct<a: {t}, top: double>>), (lines, w) -> CASE WHEN size(lines) = 0 OR abs(w.top - element_at(lines, -1).top) > {d}D "
        "THEN concat(lines, array(w)) ELSE lines END)".format(t="bigint" if flow_order else "double", d=float(tolerance))
    )
    begun = spots.select(*PAGE, F.posexplode(starts).alias("_n", "_w")).select(*PAGE, F.col("_w.a").alias("_from"), (F.col("_n") + 1).cast("int").alias("line_number"))
    # each word belongs to the last start at or before it
    marks = words.select(*words.columns, F.col(order).alias("_from"), F.lit(1).alias("_word"), F.lit(None).cast("int").alias("_line"))
    both = marks.unionByName(begun.select(*PAGE, "_from", F.lit(0).alias("_word"), F.col("line_number").alias("_line")), allowMissingColumns=True)
    w = Window.partitionBy(*PAGE).orderBy("_from", "_word").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("line_number", F.last("_line", ignorenulls=True).over(w)).where("_word = 1").drop("_from", "_word", "_line")


def combined_words(words: DataFrame, tolerance: float = DEFAULTS.x_tolerance) -> DataFrame:
    """Words of a line merged where the next starts within ``tolerance`` of the
    last one's end; texts are joined without a space."""
    w = Window.partitionBy(*LINE).orderBy("x0", "word_seq")
    near = F.coalesce(F.abs(F.col("x0") - F.lag("x1").over(w)) <= tolerance, F.lit(False))
    parts = words.withColumn("_new", F.when(near, 0).otherwise(1)).withColumn("part", F.sum("_new").over(w))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_seq", "text"))), lambda s: s["text"])
    return parts.groupBy(*LINE, F.col("part").cast("int").alias("part")).agg(F.array_join(texts, "").alias("text"), F.min("x0").alias("x0"), F.max_by("x1", F.struct("x0", "word_seq")).alias("x1"))


def spaced_lines(words: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Words as lines for a scan: texts joined by a space from left to right,
    the least x, and the font of the first word."""
    rows = grouped_lines(words, tolerance)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_seq", "text"))), lambda s: s["text"])
    first = F.struct("x0", "word_seq")
    return rows.groupBy(*LINE).agg(F.array_join(texts, " ").alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.min_by("fontname", first).alias("predominant_font"), F.min_by("size", first).alias("predominant_size"))


def segments(words: DataFrame) -> DataFrame:
    """Runs of one font, size and direction in a line, words left to right."""
    w = Window.partitionBy(*LINE).orderBy("x0", "word_seq")
    style = F.struct("fontname", "size", F.coalesce("upright", F.lit(True)).alias("upright"))
    rows = words.withColumn("_style", style).withColumn("_new", F.when(F.lag("_style").over(w).eqNullSafe(F.col("_style")), 0).otherwise(1))
    numbered = rows.withColumn("seg_no", F.sum("_new").over(w).cast("int"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_seq", "text"))), lambda s: s["text"])
    first = F.struct("x0", "word_seq")
    return numbered.groupBy(*LINE, "seg_no").agg(
        F.min_by("fontname", first).alias("font"), F.min_by("size", first).alias("reported_size"), round_to(F.min_by("size", first), 0.5).alias("rounded_size"),
        F.when(F.min_by("_style", first)["upright"], "upright").otherwise("rotated").alias("direction"), strip(F.array_join(texts, "")).alias("text"),
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"),
    )


def predominant(segs: DataFrame) -> DataFrame:
    """Each line's box and its widest size and font with their coverage in %."""
    width = F.col("x1") - F.col("x0")
    lines = segs.groupBy(*LINE).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.sum(width).alias("total"))
    out = lines
    for name, column in (("size", "rounded_size"), ("font", "font")):
        sums = segs.groupBy(*LINE, column).agg(F.sum(width).alias("w"), F.min("seg_no").alias("at"))
        best = sums.groupBy(*LINE).agg(F.max_by(column, F.struct("w", -F.col("at"))).alias(f"predominant_{name}"), F.max("w").alias(f"_{name}"))
        out = out.join(best, list(LINE)).withColumn(f"predominant_{name}_coverage", F.when(F.col("total") > 0, F.col(f"_{name}") / F.col("total") * 100).otherwise(F.lit(0.0)))
    return out.drop("total", "_size", "_font")


def proportional_text(segs: DataFrame, params: LayoutParams = DEFAULTS) -> DataFrame:
    """Each line's text with single spaces and with as many as its gaps are
    wide, and what each gap was. Blank segments count as gap."""
    w = Window.partitionBy(*LINE).orderBy("seg_no")
    kept = segs.where(~is_blank(F.col("text")))
    size = F.coalesce(F.nullif(F.col("rounded_size"), F.lit(0.0)), F.col("reported_size"), F.lit(params.default_font_size))
    gap, space = F.col("x0") - F.lag("x1").over(w), F.lag(size).over(w) * params.space_width_ratio
    index = F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)) - 1
    rows = kept.select(*LINE, "seg_no", "text", gap.alias("gap"), space.alias("space"), index.cast("int").alias("at")).withColumn("n", F.greatest(F.lit(1), F.rint(F.col("gap") / F.col("space")).cast("int")))
    rows = rows.withColumn("n", F.when(F.col("gap").isNotNull(), F.col("n")))
    ordered = F.array_sort(F.collect_list(F.struct("seg_no", "text", "at", "gap", "space", "n")))
    lines = rows.groupBy(*LINE).agg(ordered.alias("s"))
    info = F.transform(F.filter("s", lambda x: x["n"].isNotNull()), lambda x: F.struct(x["at"].alias("normalized_text_index"), x["gap"].alias("raw_gap_pt"), x["space"].alias("estimated_space_width_pt"), x["n"].alias("proportional_spaces")))
    spaced = F.transform("s", lambda x: F.concat(F.when(x["n"].isNull(), F.lit("")).otherwise(F.repeat(F.lit(" "), x["n"])), x["text"]))
    return lines.select(*LINE, F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"), F.array_join(spaced, "").alias("text_proportional"), info.alias("spacing_info"))


def compared(text: DataFrame, lines: DataFrame, words: DataFrame) -> DataFrame:
    """Three extractions of a page side by side by line; null where one is shorter."""
    on = list(LINE)
    named = [d.select(*LINE, F.col("text").alias(n)) for d, n in ((text, "text"), (lines, "lines"), (words, "words"))]
    return named[0].join(named[1], on, "full").join(named[2], on, "full")


def differing(compare: DataFrame) -> DataFrame:
    """Rows on which the three methods differ, and lines a page by each."""
    distinct = F.size(F.array_distinct(F.array_compact(F.array("text", "lines", "words"))))
    pages = F.count_distinct(F.struct("doc_id", "page"))
    return compare.agg(F.count_if(distinct > 1).alias("differing"), *[(F.count(c) / pages).alias(f"{c}_per_page") for c in ("text", "lines", "words")])


def word_distances(words: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Height, step and gap to the word above; the first is measured from 0."""
    w = Window.partitionBy(*by).orderBy("top", "word_seq")
    return words.select(*by, "word_seq", (F.col("bottom") - F.col("top")).alias("height"), (F.col("top") - F.lag("top", 1, 0.0).over(w)).alias("y0_dist"), (F.col("top") - F.lag("bottom", 1, 0.0).over(w)).alias("y_gap"))


def font_runs(chars: DataFrame) -> DataFrame:
    """Runs of one font over characters; white space never ends a run."""
    w = Window.partitionBy(*PAGE).orderBy("char_seq")
    seen = F.last(F.when(~is_blank(F.col("text")), F.col("fontname")), ignorenulls=True).over(w)
    rows = chars.withColumn("_font", F.coalesce(seen, F.col("fontname")))
    rows = rows.withColumn("_new", F.when(F.lag("_font").over(w).eqNullSafe(F.col("_font")), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w).cast("int"))
    letters = F.transform(F.array_sort(F.collect_list(F.struct("char_seq", "text"))), lambda s: s["text"])
    return rows.groupBy(*PAGE, "run", F.col("_font").alias("font")).agg(F.array_join(letters, "").alias("text"), F.count(F.lit(1)).alias("n"))


def attribute_counts(words: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """How often each attribute is there, and its share of all words in %."""
    counted = words.agg(F.count(F.lit(1)).alias("total"), *[F.count(a).alias(a) for a in attributes])
    rows: list[Column] = [F.struct(F.lit(a).alias("attribute"), F.col(a).alias("n"), (F.col(a) * 100.0 / F.nullif(F.col("total"), F.lit(0))).alias("percent")) for a in attributes]
    return counted.select(F.inline(F.array(*rows)))


def sizes_per_font(lines: DataFrame) -> DataFrame:
    return lines.groupBy("predominant_font").agg(F.array_join(F.transform(F.array_sort(F.collect_set("predominant_size")), lambda v: F.format_string("%.1f", v)), ",").alias("sizes"))
