"""Pattern catalogue, scan of lines, and statistics of what was found."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.errors import PatternError

# Name, regex, type, hierarchy level of the built-in patterns.
PATTERNS = (
    ("decimal_simple", r"^(\d+(?:\.\d+)*)\s+[A-Z]", "section", None),
    ("decimal_with_letter_prefix", r"^([A-Z]\.\d+(?:\.\d+)*)\s+[A-Z]", "section", None),
    ("decimal_no_space_numeric", r"^(\d+(?:\.\d+)+)[A-Z][a-z]", "section", None),
    ("decimal_no_space_letter", r"^([A-Z]\d+(?:\.\d+)*)[A-Z][a-z]", "section", None),
    ("decimal_letter_suffix", r"^(\d+(?:\.\d+)*[A-Z])\s+[A-Z]", "section", None),
    ("letter_decimal_mixed", r"^([A-Z]\d+(?:\.\d+)*)\s+[A-Z]", "section", None),
    ("roman_uppercase", r"^([IVX]+)\s+[A-Z]", "section", None),
    ("roman_lowercase", r"^([ivx]+)\s+[A-Za-z]", "section", None),
    ("roman_parentheses", r"^\(([ivx]+)\)\s+[A-Za-z]", "section", None),
    ("letter_simple", r"^([A-Z])\s+[A-Z][a-z]", "section", 1),
    ("letter_parentheses", r"^\(([a-z])\)\s+[A-Za-z]", "section", None),
    ("letter_dot", r"^([a-z])\.\s+[A-Za-z]", "section", None),
    ("annex_heading", r"^(Annex\s+[A-Z])", "section", 1),
    ("appendix_heading", r"^(Appendix\s+[A-Z])", "section", 1),
    ("chapter_pattern", r"^(Chapter\s+\d+)", "section", 1),
    ("part_pattern", r"^(Part\s+[IVX\d]+)", "section", 1),
    ("section_explicit", r"^(Section\s+\d+(?:\.\d+)*)", "section", None),
    ("roman_dot", r"^([IVX]+)\.\s+[A-Z]", "section", None),
    ("letter_single_dot", r"^([A-Z])\.\s+[A-Z]", "section", None),
    ("number_dot", r"^(\d+)\.\s+[A-Z]", "section", None),
    ("decimal_no_space_letter_prefix", r"^([A-Z]\.\d+(?:\.\d+)*)[A-Z][a-z]", "section", None),
    ("toc_title_contents", r"(Table\s+of\s+Contents|Contents)", "toc_title", None),
    ("toc_title_list_figures", r"(List\s+of\s+Figures)", "toc_title", None),
    ("toc_title_list_tables", r"(List\s+of\s+Tables)", "toc_title", None),
    ("toc_entry_dotted", r"(\d+(?:\.\d+)*)\s+(.+?)\s+\.{3,}\s+(\d+)", "toc_entry", None),
    ("toc_entry_simple", r"(\d+(?:\.\d+)*)\s+(.+?)\s+(\d+)$", "toc_entry", None),
    ("figure_caption", r"^(Figure\s+\d+(?:-\d+)?)\s*[–-]", "figure", None),
    ("table_caption", r"^(Table\s+\d+(?:-\d+)?)\s*[–:-]", "table", None),
    ("figure_reference", r"(Figure\s+\d+(?:-\d+)?)", "figure", None),
    ("table_reference", r"(Table\s+\d+(?:-\d+)?)", "table", None),
    ("page_number_simple", r"^(\d+)$", "page_number", None),
    ("page_number_formatted", r"(Page\s+\d+|\d+\s+of\s+\d+)", "page_number", None),
)

# The pattern sets, in their order.
SETS = {
    "section_patterns": (
        "decimal_simple", "decimal_with_letter_prefix", "decimal_no_space_numeric", "decimal_no_space_letter", "decimal_no_space_letter_prefix",
        "decimal_letter_suffix", "letter_decimal_mixed", "roman_uppercase", "roman_lowercase", "roman_parentheses", "roman_dot",
        "letter_simple", "letter_parentheses", "letter_dot", "letter_single_dot", "number_dot",
        "annex_heading", "appendix_heading", "chapter_pattern", "part_pattern", "section_explicit",
    ),
    "toc_patterns": ("toc_title_contents", "toc_title_list_figures", "toc_title_list_tables", "toc_entry_dotted", "toc_entry_simple"),
    "figure_table_patterns": ("figure_caption", "table_caption", "figure_reference", "table_reference"),
    "page_number_patterns": ("page_number_simple", "page_number_formatted"),
}

Pattern = tuple[str, str, str, "int | None"]


def catalogue(spark: SparkSession, patterns: Iterable[Pattern] = PATTERNS) -> DataFrame:
    """(ord, name, regex, pattern_type, hierarchy_level)."""
    rows = [(i, *p) for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "ord int, name string, regex string, pattern_type string, hierarchy_level int")


def pattern_sets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, n, i) for s, names in SETS.items() for i, n in enumerate(names)], "set_name string, name string, ord int")


def merged(base: Iterable[Pattern], extra: Iterable[Pattern]) -> tuple[Pattern, ...]:
    """Patterns with others added; a later one replaces one of its name."""
    return tuple({p[0]: p for p in (*base, *extra)}.values())


def validate(patterns: Iterable[Pattern]) -> list[str]:
    """What is wrong with each pattern that doesn't compile or has no group."""
    wrong = []
    for name, regex, *_ in patterns:
        try:
            if not re.compile(regex).groups:
                wrong.append(f"{name}: no group")
        except re.error as error:
            wrong.append(f"{name}: {error}")
    return wrong


def pattern_set(name: str) -> tuple[str, ...]:
    if name not in SETS:
        raise PatternError(f"no pattern set {name!r}", suggestion=f"known: {', '.join(SETS)}")
    return SETS[name]


HIT = "array<struct<pattern_name: string, match_no: int, match: string, number: string>>"


def scan(lines: DataFrame, patterns: Sequence[Pattern] = PATTERNS, keys: Sequence[str] = ("doc_id", "page", "line_number"), text: str = "text") -> DataFrame:
    """(keys, pattern_name, match_no, match, number): every match of every
    pattern, and its first group. The patterns are literals of one projection,
    so no pair of line and pattern without a match becomes a row."""
    if wrong := validate(patterns):
        raise PatternError("invalid patterns", {"patterns": "; ".join(wrong)})

    def found(name: str, regex: str) -> Column:
        rx = F.lit("(?U)" + regex)
        both = F.arrays_zip(F.regexp_extract_all(text, rx, F.lit(0)).alias("m"), F.regexp_extract_all(text, rx, F.lit(1)).alias("g"))
        hit = F.transform(both, lambda z, i: F.struct(F.lit(name).alias("pattern_name"), i.cast("int").alias("match_no"), z["m"].alias("match"), z["g"].alias("number")))
        # most lines match few patterns: one look decides whether any match is taken out
        return F.when(F.rlike(text, rx), hit).otherwise(F.array().cast(HIT))

    hits = F.flatten(F.array(*[found(n, r) for n, r, *_ in patterns]))
    return lines.where(F.col(text).isNotNull()).select(*keys, F.explode(hits).alias("h")).select(*keys, "h.*")


def statistics(matches: DataFrame, patterns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Matches and distinct pages of each pattern, those without any included."""
    page = F.struct("doc_id", "page")
    seen = matches.groupBy("pattern_name").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct(page).alias("pages"))
    return patterns.join(seen, patterns["name"] == seen["pattern_name"], "left").select(
        "name", "pattern_type", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("pages", F.lit(0)).alias("pages")
    )


def confidence(stats: DataFrame, pattern_type: str) -> DataFrame:
    """Share of a type's patterns that hit, plus up to 0.3 for their matches."""
    of_type = stats.where(F.col("pattern_type").startswith(pattern_type))
    hits, total, scanned = F.count_if(F.col("matches") > 0), F.coalesce(F.sum("matches"), F.lit(0)), F.count(F.lit(1))
    score = F.least(hits / scanned + F.least(total / 50, F.lit(0.3)), F.lit(1.0))
    return of_type.agg(hits.alias("hits"), total.alias("matches"), F.when(total > 0, score).otherwise(F.lit(0.0)).alias("confidence"))


def by_type(matches: DataFrame, patterns: DataFrame) -> DataFrame:
    """Matches with their pattern's type and level, as downstream steps ask for them."""
    known = F.broadcast(patterns.select(F.col("name").alias("pattern_name"), "pattern_type", "hierarchy_level"))
    return matches.join(known, "pattern_name")


def font_parts(font: Column, size: Column) -> Column:
    """family|size|style: what stands before the first hyphen, and the style
    that the name tells; Unknown and Regular where nothing is known."""
    name = F.coalesce(font, F.lit(""))
    bold, italic = F.contains(name, F.lit("Bold")), F.contains(name, F.lit("Italic"))
    style = F.when(bold & italic, "Bold+Italic").when(bold, "Bold").when(italic, "Italic").otherwise("Regular")
    family = F.coalesce(F.nullif(F.split_part(name, F.lit("-"), F.lit(1)), F.lit("")), F.lit("Unknown"))
    return F.concat_ws("|", family, F.coalesce(size.cast("string"), F.lit("Unknown")), style)


def font_usage(lines: DataFrame) -> DataFrame:
    """(doc_id, font_key, total, n_pages, share) of each font in a document."""
    key = font_parts(F.col("predominant_font"), F.col("predominant_size")).alias("font_key")
    used = lines.groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("total"), F.count_distinct("page").alias("n_pages"), F.min(F.struct("page", "line_number")).alias("_first"))
    whole = used.groupBy("doc_id").agg(F.sum("total").alias("_all"))
    return used.join(whole, "doc_id").select("doc_id", "font_key", "total", "n_pages", (F.col("total") / F.col("_all")).alias("share"), "_first")


def body_font(usage: DataFrame) -> DataFrame:
    """The commonest font of each document, the first to appear among equals."""
    order = F.struct(-F.col("total"), F.col("_first"))
    return usage.groupBy("doc_id").agg(F.min_by("font_key", order).alias("body_font"), F.count(F.lit(1)).alias("n_fonts"))


def document_context(lines: DataFrame) -> DataFrame:
    """Pages, the first page's size, and the body font of each document."""
    pages = lines.groupBy("doc_id").agg(
        F.count_distinct("page").alias("n_pages"), F.coalesce(F.min_by("page_width", F.struct("page", "line_number")), F.lit(612.0)).alias("page_width"),
        F.coalesce(F.min_by("page_height", F.struct("page", "line_number")), F.lit(792.0)).alias("page_height"),
    )
    return pages.join(body_font(font_usage(lines)), "doc_id")
