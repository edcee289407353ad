"""Other inputs: word metadata by page name, characters, prompt results, fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.errors import SourceError

WORD = "array<struct<text: string, x0: double, top: double, size: double, fontname: string>>"


def word_metadata(rows: DataFrame, column: str = "json") -> DataFrame:
    """(page, word_no, word fields) of an object whose keys are ``Page n``."""
    kept = [c for c in rows.columns if c != column]
    pages = rows.select(*kept, F.explode(F.from_json(column, f"map<string, {WORD}>")).alias("name", "words"))
    each = pages.select(*kept, F.regexp_extract("name", r"\d+", 0).cast("int").alias("page"), F.posexplode("words").alias("word_no", "w"))
    return each.select(*kept, "page", "word_no", "w.*")


def banded(chars: DataFrame, band: float = 10.0) -> DataFrame:
    """Characters with the number of the band of 10 points they stand in."""
    return chars.withColumn("line_number", F.floor(F.col("top") / band).cast("int"))


def prompt_results(rows: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """Adds ``response``: ``response_content`` as an object or as a JSON string."""
    doc = F.try_parse_json(column)
    text = F.coalesce(F.try_variant_get(doc, "$.response_content", "string"), F.to_json(F.struct(F.try_variant_get(doc, "$.response_content", "variant").alias("v"))))
    inner = F.from_json(text, schema)
    wrapped = F.from_json(text, f"struct<v: {schema}>")["v"]
    return rows.select("*", F.coalesce(wrapped, inner).alias("response"))


def chosen_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted (doc_id, page), in page order when written."""
    return pages.join(F.broadcast(wanted.select("doc_id", "page").distinct()), ["doc_id", "page"], "left_semi")


def missing_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted pages that are not there."""
    return wanted.select("doc_id", "page").distinct().join(pages.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def require_all(pages: DataFrame, wanted: DataFrame) -> None:
    lost = [tuple(r) for r in missing_pages(pages, wanted).orderBy("doc_id", "page").limit(5).collect()]
    if lost:
        raise SourceError("pages are missing", {"first": lost}, "ask for pages within the document")


def comprehensive_fixture(contents: DataFrame, body: DataFrame) -> DataFrame:
    """Generated contents pages with body pages after them."""
    last = contents.agg(F.coalesce(F.max("page"), F.lit(0)).alias("_last"))
    shifted = body.join(F.broadcast(last), how="cross").withColumn("page", (F.col("page") + F.col("_last")).cast("int")).drop("_last")
    return contents.select("page", "line_number", "text").unionByName(shifted.select("page", "line_number", "text"))
