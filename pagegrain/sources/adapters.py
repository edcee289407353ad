"""Tables of words and lines from text, events and nested page records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.errors import ShapeError

#: Lines on an adapted page, and fonts that adapted lines are set in.
LINES_PER_PAGE = 8
FONTS = ("Times-Roman", "Times-Bold", "Arial-BoldItalic", "Courier")


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, text): one row per line of a plain text; null texts give one empty line."""
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "text"))


def layout_lines(docs: DataFrame) -> DataFrame:
    """Plain texts as laid-out lines. Geometry is arithmetic of position and
    length in quarter points, so every engine computes it exactly."""
    from pyspark.sql import Window

    n = F.length("text")
    rows = text_lines(docs).select(
        "doc_id", (F.floor(F.col("pos") / LINES_PER_PAGE) + 1).cast("int").alias("page"), (F.col("pos") % LINES_PER_PAGE + 1).cast("int").alias("line_number"), "text",
        (10 + 2 * F.pmod(F.col("doc_id") + n, F.lit(3))).cast("double").alias("predominant_size"),
        F.element_at(F.array(*[F.lit(f) for f in FONTS]), (F.pmod(F.col("doc_id") + n, F.lit(len(FONTS))) + 1).cast("int")).alias("predominant_font"),
        (F.pmod(3 + n * 7 + F.col("pos") * 3, F.lit(11)) * 0.75).alias("lead"), n.alias("n"),
    )
    so_far = Window.partitionBy("doc_id", "page").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("bottom", F.sum(F.col("lead") + F.col("predominant_size")).over(so_far))
    return placed.select(
        "doc_id", "page", "line_number", "text", "predominant_size", "predominant_font",
        (72 + F.col("n") % 5 * 4.5).alias("x0"), (F.col("bottom") - F.col("predominant_size")).alias("top"),
        (72 + F.col("n") % 5 * 4.5 + F.col("n") * 4.5).alias("x1"), "bottom", F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"),
    )


def event_words(events: DataFrame) -> DataFrame:
    """Events as words: a page per user, the value as top, three sizes and fonts."""
    i = F.col("event_id")
    return events.select(
        F.lit(1).cast("bigint").alias("doc_id"), F.col("user_id").cast("int").alias("page"), i.alias("word_seq"),
        F.concat("event_type", F.lit("-"), (i % 97).cast("string")).alias("text"),
        (F.pmod(i * 37, F.lit(500)) * 1.0).alias("x0"), (F.pmod(i * 37, F.lit(500)) + F.pmod(i, F.lit(29)) + 3.0).alias("x1"),
        F.col("value").alias("top"), (F.col("value") + 10.0).alias("bottom"),
        F.element_at(F.array(*[F.lit(f) for f in FONTS]), (F.pmod(F.floor(i / 5), F.lit(4)) + 1).cast("int")).alias("fontname"),
        (9.0 + F.pmod(F.floor(i / 7), F.lit(3)) * 1.25).alias("size"), (F.pmod(i, F.lit(50)) != 0).alias("upright"),
    )


#: Keys that may hold a page's content, best first.
CONTENT_KEYS = ("blocks", "lines", "words", "text_blocks")


def page_records(rows: DataFrame, column: str = "json") -> DataFrame:
    """Page JSON of any known shape as (page, kind, item_no, item): a list of
    pages or an object with ``pages``; of a page's content keys the first that
    is there counts, else its ``text`` is split into lines."""
    doc = F.try_parse_json(F.col(column))
    pages = rows.select("*", F.coalesce(F.try_variant_get(doc, "$.pages", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>")).alias("_pages"))
    each = pages.select(*[c for c in rows.columns if c != column], F.posexplode("_pages").alias("_at", "_page"))
    items = F.lit(None).cast("struct<kind: string, items: array<string>>")
    text = F.try_variant_get("_page", "$.text", "string")
    items = F.when(text.isNotNull(), F.struct(F.lit("text").alias("kind"), F.split(text, "\n").alias("items"))).otherwise(items)
    for key in reversed(CONTENT_KEYS):
        found = F.try_variant_get("_page", f"$.{key}", "array<variant>")
        as_text = F.transform(found, lambda v: F.coalesce(F.try_variant_get(v, "$.text", "string"), F.array_join(F.try_variant_get(v, "$.text_lines", "array<string>"), "\n"), F.try_variant_get(v, "$", "string")))
        items = F.when(found.isNotNull(), F.struct(F.lit(key).alias("kind"), as_text.alias("items"))).otherwise(items)
    number = F.coalesce(F.try_variant_get("_page", "$.page", "int"), F.try_variant_get("_page", "$.page_number", "int"), F.col("_at") + 1)
    kept = [c for c in rows.columns if c != column]
    return each.select(*kept, number.alias("page"), items.alias("_i")).select(*kept, "page", "_i.kind", F.posexplode_outer("_i.items").alias("item_no", "item"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page JSON files under a path, whole files as rows of (path, json)."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    return files


def require_pages(records: DataFrame) -> None:
    """Refuses an input none of whose pages has content of a known shape."""
    if records.where("kind IS NOT NULL").isEmpty():
        raise ShapeError("no page has blocks, lines, words or text", suggestion="give a list of pages or an object with pages")


def page_range(pages: DataFrame, start: int | None = None, stop: int | None = None, page: str = "page") -> DataFrame:
    """Pages from start to stop, both kept, and of them rows that are not blank."""
    if start is not None and stop is not None and start > stop:
        raise ValueError("start is after stop")
    cond: Column = F.lit(True)
    if start is not None:
        cond = cond & (F.col(page) >= start)
    if stop is not None:
        cond = cond & (F.col(page) <= stop)
    return pages.where(cond)


def page_set(spark: SparkSession, expression: str, most: int, exclude: str = "") -> DataFrame:
    """(page) of an expression like ``1-3,5`` less that of the excluded pages;
    an empty expression means 1..most."""

    def parts(text: str) -> DataFrame:
        given = spark.createDataFrame([(text,)], "s string").select(F.explode(F.split("s", ",")).alias("p")).where(F.trim("p") != "")
        ends = F.transform(F.split("p", "-"), lambda e: F.trim(e).cast("int"))
        return given.select(F.explode(F.sequence(F.get(ends, 0), F.element_at(ends, -1))).alias("page")).distinct()

    return parts(expression or f"1-{most}").join(parts(exclude), "page", "left_anti")


def objects(images: DataFrame, annotations: DataFrame, shapes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Objects that are no text, as one table (page, type, x0, y0, x1, y1,
    metadata): annotations whose four texts are all blank are dropped."""
    box = ["page", "x0", "y0", "x1", "y1"]
    noted = annotations.where(~F.forall(F.array("title", "contents", "uri", "subject"), lambda t: F.trim(F.coalesce(t, F.lit(""))) == ""))
    kinds = [
        images.select(*box, F.lit("image").alias("type"), F.col("name").alias("metadata")),
        noted.select(*box, F.when(F.col("uri").isNotNull(), "hyperlink").otherwise("annotation").alias("type"), F.coalesce("uri", "contents", "title", "subject").alias("metadata")),
        shapes.select(*box, "type", F.lit(None).cast("string").alias("metadata")),
    ]
    if edges is not None:
        kinds.append(edges.select(*box, F.lit("edge").alias("type"), F.lit(None).cast("string").alias("metadata")))
    out = kinds[0]
    for more in kinds[1:]:
        out = out.unionByName(more)
    return out.select("page", "type", "x0", "y0", "x1", "y1", "metadata")


def toc_page(entries: DataFrame) -> DataFrame:
    """Lines of a table of contents from (page, entry_no, number, title, level,
    target): dot leaders, an indent of 20 a level and 15 points a line."""
    label, target = F.concat_ws(" ", "number", "title"), F.col("target").cast("string")
    room = 70 - F.length(label) - F.length(target)
    dots = F.when(room > 0, F.concat(F.lit(" "), F.repeat(F.lit("."), F.least(room, F.lit(30))))).otherwise(F.lit(""))
    return entries.select(
        "page", F.col("entry_no").alias("line_number"), F.concat(label, dots, F.lit(" "), target).alias("text"),
        (72.0 + 20.0 * (F.col("level") - 1)).alias("x0"), (100.0 + 15.0 * (F.col("entry_no") - 1)).alias("top"),
    )
