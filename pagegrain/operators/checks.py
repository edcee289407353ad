"""Checks and small reports over lines, matches and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions.scalar import strip


def contents_flags(lines: DataFrame) -> DataFrame:
    """What of a table of contents each line looks like."""
    text = F.col("text")
    return lines.select(
        "doc_id", "page", "line_number", text.rlike("(?i)contents").alias("is_header"), text.rlike(r"\d+\.\d+").alias("has_section"),
        text.rlike(r"\.\s*\d+\s*$").alias("has_page_number"), text.rlike(r"\d+\.\d+\.\d+").alias("has_three_levels"),
    )


def structure_problems(pages: DataFrame) -> DataFrame:
    """(doc_id, page, problems): what a page record lacks."""
    checks = [
        F.when(F.col("page").isNull(), F.lit("page")), F.when(F.col("n_blocks").isNull() | (F.col("n_blocks") < 1), F.lit("blocks")),
        F.when(F.col("page_width").isNull() | (F.col("page_width") <= 0), F.lit("page_width")), F.when(F.col("page_height").isNull() | (F.col("page_height") <= 0), F.lit("page_height")),
    ]
    return pages.select("doc_id", "page", F.array_join(F.array_compact(F.array(*checks)), ",").alias("problems"))


def parsed_list(text: Column) -> Column:
    """Items of a comma-separated list, stripped."""
    return F.transform(F.split(text, ","), strip)


def estimates(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Tokens by four, three and a half, and three characters each."""
    n = F.length(text)
    return texts.select(key, *[F.floor(n / F.lit(k)).cast("bigint").alias(name) for k, name in ((4.0, "by_four"), (3.5, "by_three_and_half"), (3.0, "by_three"))])


def fonts_by_lines(segments: DataFrame) -> DataFrame:
    """(font, size, lines, partial_lines): lines that a font stands in, and
    those of them that hold more than one."""
    line = ["doc_id", "page", "line_number"]
    kinds = segments.groupBy(*line).agg(F.count_distinct(F.struct("font", "rounded_size")).alias("_kinds"))
    rows = segments.select(*line, "font", "rounded_size").distinct().join(kinds, line)
    return rows.groupBy("font", F.col("rounded_size").alias("size")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("_kinds") > 1).alias("partial_lines"))


def state_results(statistics: DataFrame) -> DataFrame:
    """Of each type, the patterns that were found and their matches."""
    return statistics.groupBy("pattern_type").agg(F.count_if(F.col("matches") > 0).alias("patterns_found"), F.sum("matches").alias("matches"))


def merged_batches(batches: DataFrame) -> DataFrame:
    """Page rows of several batches as one, each page from the first batch that
    tells it; true page numbers are kept."""
    return batches.groupBy("doc_id", "page").agg(F.min_by("content", "batch_no").alias("content"), F.min("batch_no").alias("batch_no"))


def used_pages(samples: DataFrame) -> DataFrame:
    """Pages that groups or singles of earlier samples have used."""
    groups = samples.select("doc_id", F.explode(F.flatten("groups")).alias("page"))
    return groups.unionByName(samples.select("doc_id", F.explode("singles").alias("page"))).distinct()


def sections_in_contents(sections: DataFrame, contents: DataFrame) -> DataFrame:
    """Section headings beside contents entries by number; null where one lacks."""
    a = sections.select("number", F.col("title").alias("heading"), F.col("page").alias("heading_page"))
    return a.join(contents.select("number", F.col("title").alias("entry"), F.col("target").alias("entry_page")), "number", "full")


def with_responses(tests: DataFrame, responses: DataFrame, labels: DataFrame) -> DataFrame:
    """Test results with their response, which may be missing, and page label."""
    found = tests.join(responses, "test_id", "left").join(F.broadcast(labels), "page", "left")
    return found.withColumn("label", F.coalesce("label", F.lit("Unknown page")))


def text_view(lines: DataFrame) -> DataFrame:
    """A page as text: each line with its position, and its gap where it is large."""
    gap = F.when(F.col("gap_before") >= 5, F.format_string("  [%.2f pt]", "gap_before")).otherwise(F.lit(""))
    return lines.select("doc_id", "page", "line_number", F.concat(F.format_string("%8.2f  ", "top"), F.coalesce("text", F.lit("")), gap).alias("line"))


def top_fonts(usage: DataFrame, most: int = 10) -> DataFrame:
    """The commonest fonts over all documents."""
    return usage.groupBy("font_key").agg(F.sum("total").alias("total")).orderBy(F.desc("total"), "font_key").limit(most)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed by a mapping; others stay."""
    return df.withColumnsRenamed(names)


def rounded(df: DataFrame, places: int) -> DataFrame:
    """Every double and float column rounded, halves to even."""
    return df.select(*[F.bround(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
