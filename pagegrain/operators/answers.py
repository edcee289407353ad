"""A model's answers as tables: JSON out of free text, checked and exploded."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagegrain.functions.scalar import confidence

ELEMENT = "array<struct<text: string, number: string, title: string, y_position: double, font_name: string, font_size: double, hierarchy_level: int, page_reference: string, confidence: string>>"
PAGE_ANALYSIS = (
    "struct<page_index: int, header: struct<detected: boolean, confidence: string, y_boundary: string>, footer: struct<detected: boolean, confidence: string, y_boundary: string>, "
    f"document_elements: struct<section_headings: {ELEMENT}, figure_titles: {ELEMENT}, table_titles: {ELEMENT}, table_of_contents: {ELEMENT}>, section_headings: {ELEMENT}>"
)
ANSWER = f"struct<sampling_summary: string, per_page_analysis: array<{PAGE_ANALYSIS}>, header_pattern: struct<reasoning: string>, footer_pattern: struct<reasoning: string>, insights: array<string>, content_area_boundaries: struct<main_content_starts_after_y: string, main_content_ends_before_y: string, confidence: string>>"
ELEMENT_KINDS = ("section_headings", "figure_titles", "table_titles", "table_of_contents")
FENCE = r"(?s)```json\s*(.*?)\s*```"


@F.pandas_udf(StringType())
def _first_object(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first balanced {...}; braces within strings count too."""

    def find(text: str | None) -> str | None:
        if text is None or (start := text.find("{")) < 0:
            return None
        depth = 0
        for at in range(start, len(text)):
            depth += (text[at] == "{") - (text[at] == "}")
            if depth == 0:
                return text[start : at + 1]
        return None

    for batch in texts:
        yield batch.map(find)


def json_of(content: Column) -> Column:
    """The fenced JSON block of an answer, else its first balanced object. Only
    answers without a fence reach the Python fallback."""
    fenced = F.nullif(F.regexp_extract(content, FENCE, 1), F.lit(""))
    return F.coalesce(fenced, _first_object(F.when(fenced.isNull(), content)))


def problems(content: Column, parsed: Column) -> Column:
    """What is wrong with an answer: marks of truncation or comments, JSON that
    can't be read, required fields that are missing."""
    checks = [
        F.when(content.isNull() | (F.trim(content) == ""), F.lit("empty")), F.when(content.rlike(r"\.\.\.\s*(\]|\})|\[truncated\]"), F.lit("truncated")),
        F.when(content.rlike(r"(?m)^\s*//"), F.lit("comment")), F.when(parsed.isNull(), F.lit("no JSON object")),
        F.when(parsed.isNotNull() & parsed["per_page_analysis"].isNull(), F.lit("per_page_analysis is missing")),
    ]
    return F.array_compact(F.array(*checks))


def parsed(answers: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``answer``, null where it can't be read, and ``problems``."""
    rows = answers.withColumn("_json", json_of(F.col(content))).withColumn("answer", F.from_json("_json", ANSWER))
    return rows.withColumn("answer", F.when(F.json_object_keys("_json").isNotNull(), F.col("answer"))).withColumn("problems", problems(F.col(content), F.col("answer"))).drop("_json")


def pages(answers: DataFrame, key: str = "answer_id") -> DataFrame:
    return answers.select(key, F.explode("answer.per_page_analysis").alias("p")).select(
        key, "p.page_index", F.coalesce("p.header.detected", F.lit(False)).alias("has_header"), confidence(F.col("p.header.confidence")).alias("header_confidence"),
        F.coalesce("p.footer.detected", F.lit(False)).alias("has_footer"), F.col("p.document_elements").alias("elements"), F.col("p.section_headings").alias("old_headings"),
    )


def elements(found: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, page_index, element_type, element fields): all elements of all
    pages; headings come from the new place or the old one."""
    lists = [F.coalesce(F.col("elements")[k], F.col("old_headings") if k == "section_headings" else F.lit(None).cast(ELEMENT)) for k in ELEMENT_KINDS]
    tagged = F.array(*[F.struct(F.lit(k).alias("element_type"), v.alias("items")) for k, v in zip(ELEMENT_KINDS, lists)])
    each = found.select(key, "page_index", F.explode(tagged).alias("t")).select(key, "page_index", "t.element_type", F.posexplode("t.items").alias("item_no", "e"))
    return each.select(key, "page_index", "element_type", "item_no", "e.text", "e.number", "e.title", "e.hierarchy_level", "e.page_reference")


def content_area(answers: DataFrame, key: str = "answer_id") -> DataFrame:
    """Where the content starts and ends; 0, 792 and Low where not told."""
    area = F.col("answer.content_area_boundaries")
    number = lambda c, other: F.coalesce(c.try_cast("double"), F.lit(other))
    return answers.select(
        key, number(area["main_content_starts_after_y"], 0.0).alias("start_y"), number(area["main_content_ends_before_y"], 792.0).alias("end_y"), confidence(area["confidence"]).alias("confidence"),
    )


def insights(answers: DataFrame, key: str = "answer_id") -> DataFrame:
    """The answer's insights and the reasoning of its patterns, in order."""
    told = F.array_compact(F.concat(F.coalesce("answer.insights", F.array().cast("array<string>")), F.array("answer.header_pattern.reasoning", "answer.footer_pattern.reasoning")))
    return answers.select(key, told.alias("insights"))


def finding_counts(findings: DataFrame, key: str = "answer_id", column: str = "json") -> DataFrame:
    """(key, kind, n): a list counts its items, an object that isn't empty one."""
    entries = F.explode(F.from_json(column, "map<string, string>")).alias("kind", "value")
    size = F.coalesce(F.json_array_length("value"), F.when(F.size(F.json_object_keys("value")) > 0, 1).otherwise(0))
    return findings.select(key, entries).select(key, "kind", size.alias("n"))


def toc_entries(blocks: DataFrame) -> DataFrame:
    """Contents lines (dots and a last number) by block, page and document."""
    line = F.explode("text_lines").alias("line")
    hit = F.contains("line", F.lit("...")) & F.element_at(F.split(F.trim("line"), r"\s+"), -1).rlike(r"^\d+$")
    rows = blocks.select("doc_id", "page", "block_no", line).where(hit)
    return rows.rollup("doc_id", "page", "block_no").agg(F.count(F.lit(1)).alias("entries")).where("doc_id IS NOT NULL")
