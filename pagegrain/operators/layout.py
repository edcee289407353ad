"""Spacing seen on a page: ranges, occurrences, colours, regions, margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagegrain.functions.scalar import round_to
from pagegrain.operators.spacing import PAGE, on_page

# The colours that spacings are drawn in, by rank.
RANKED_COLORS = ("red", "blue", "green", "purple", "orange", "pink", "magenta", "yellow", "lightblue", "darkred", "darkblue", "darkgreen")

# Line kinds with their dash and gap lengths; each comes in widths from 1 by halves.
LINE_KINDS = (
    ("solid", "1000:0"), ("dashed", "50:20"), ("dotted", "10:30"), ("dashdot", "50:20,10:20"),
    ("dashed", "30:15"), ("dotted", "5:20"), ("dashdot", "40:15,5:15"),
)
LINE_WIDTHS = 11

# Colour names and their red, green and blue shares.
COLORS = {
    "red": (1, 0, 0), "blue": (0, 0, 1), "green": (0, 1, 0), "purple": (0.5, 0, 0.5), "orange": (1, 0.65, 0), "pink": (1, 0.75, 0.8),
    "magenta": (1, 0, 1), "yellow": (1, 1, 0), "lightblue": (0.68, 0.85, 0.9), "darkred": (0.55, 0, 0), "darkblue": (0, 0, 0.55),
    "darkgreen": (0, 0.39, 0), "crimson": (0.86, 0.08, 0.24), "navy": (0, 0, 0.5), "forestgreen": (0.13, 0.55, 0.13), "indigo": (0.29, 0, 0.51),
    "orangered": (1, 0.27, 0), "hotpink": (1, 0.41, 0.71), "slategray": (0.44, 0.5, 0.56), "deeppink": (1, 0.08, 0.58), "darkviolet": (0.58, 0, 0.83),
    "darkorange": (1, 0.55, 0), "chocolate": (0.82, 0.41, 0.12), "dimgray": (0.41, 0.41, 0.41), "saddlebrown": (0.55, 0.27, 0.07),
    "mediumblue": (0, 0, 0.8), "mediumpurple": (0.58, 0.44, 0.86), "mediumseagreen": (0.24, 0.7, 0.44), "mediumvioletred": (0.78, 0.08, 0.52),
    "olive": (0.5, 0.5, 0), "olivedrab": (0.42, 0.56, 0.14), "peru": (0.8, 0.52, 0.25), "plum": (0.87, 0.63, 0.87), "powderblue": (0.69, 0.88, 0.9),
    "rosybrown": (0.74, 0.56, 0.56), "royalblue": (0.25, 0.41, 0.88), "sienna": (0.63, 0.32, 0.18), "skyblue": (0.53, 0.81, 0.92),
    "steelblue": (0.27, 0.51, 0.71), "tan": (0.82, 0.71, 0.55), "thistle": (0.85, 0.75, 0.85), "tomato": (1, 0.39, 0.28),
    "turquoise": (0.25, 0.88, 0.82), "violet": (0.93, 0.51, 0.93), "wheat": (0.96, 0.87, 0.7), "yellowgreen": (0.6, 0.8, 0.2),
}


def line_styles() -> list[tuple[int, str, float, str]]:
    """(rank, kind, width, dashes) of every line style, by rule."""
    return [(k * LINE_WIDTHS + i + 1, kind, 1 + 0.5 * i, dashes) for k, (kind, dashes) in enumerate(LINE_KINDS) for i in range(LINE_WIDTHS)]


def parse_ranges(text: str) -> list[tuple[int, float | None, float | None]]:
    """(number, low, high) of ``a``, ``-b``, ``a-`` and ``a-b``, by comma."""
    out = []
    for part in (p.strip() for p in text.split(",")):
        if not part:
            continue
        low, dash, high = part.partition("-")
        a = float(low) if low else None
        out.append((len(out) + 1, a, (float(high) if high else None) if dash else a))
    return out


def matched_range(values: DataFrame, column: str, ranges: list[tuple[int, float | None, float | None]]) -> DataFrame:
    """Adds range_no, the first range that holds the value; without any range
    every positive value matches as range 1. The ranges are literals."""
    v, found = F.col(column), F.lit(None).cast("int")
    for number, low, high in reversed(ranges):
        inside = (v >= (float("-inf") if low is None else low)) & (v <= (float("inf") if high is None else high))
        found = F.when(inside, number).otherwise(found)
    return values.withColumn("range_no", found if ranges else F.when(v > 0, 1))


def spacing_occurrences(lines: DataFrame, rounding: float = 0.5) -> DataFrame:
    """(doc_id, spacing, n): positive gaps at page tops, between neighbours and
    at page bottoms; for lines as for blocks that bring a box and a number."""
    w = on_page()
    rows = lines.select(*PAGE, "line_number", "top", "bottom", "page_height", F.lag("bottom").over(w).alias("above"), F.lead("top").over(w).alias("below"))
    gaps = F.array(F.when(F.col("above").isNull(), F.col("top")).otherwise(F.col("top") - F.col("above")), F.when(F.col("below").isNull(), F.col("page_height") - F.col("bottom")))
    return rows.select("doc_id", F.explode(gaps).alias("gap")).where("gap > 0").groupBy("doc_id", round_to(F.col("gap"), rounding).alias("spacing")).agg(F.count(F.lit(1)).alias("n"))


def ranked_styles(occurrences: DataFrame) -> DataFrame:
    """Each spacing's rank by frequency in its document and its colour and line
    style; colours beyond the last are the first, line styles go round."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "spacing")
    ranked = occurrences.withColumn("rank", F.row_number().over(w))
    color = F.coalesce(F.get(F.array(*[F.lit(c) for c in RANKED_COLORS]), F.col("rank") - 1), F.lit(RANKED_COLORS[0]))
    styles = line_styles()
    at = F.pmod(F.col("rank") - 1, F.lit(len(styles))).cast("int")
    return ranked.select("*", color.alias("color"), F.get(F.array(*[F.lit(s[1]) for s in styles]), at).alias("style"), F.get(F.array(*[F.lit(s[2]) for s in styles]), at).alias("width"))


def legend_rows(ranked: DataFrame, page_height: float = 792.0) -> DataFrame:
    """The legend page and row of every rank: 16 points a row, an inch of margin."""
    per_page = int((page_height - 144) // 16)
    return ranked.select("doc_id", "rank", "spacing", F.floor((F.col("rank") - 1) / per_page).cast("int").alias("legend_page"), F.pmod(F.col("rank") - 1, F.lit(per_page)).cast("int").alias("legend_row"))


def colors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *map(float, c)) for n, c in COLORS.items()], "name string, red double, green double, blue double")


def margins(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*PAGE).agg(
        F.min("x0").alias("left"), (F.max("page_width") - F.max("x1")).alias("right"), F.min("top").alias("top"), (F.max("page_height") - F.max("bottom")).alias("bottom")
    )


def regions(lines: DataFrame) -> DataFrame:
    """Used and unused height of each line, its indent, font and preview, and
    one more row a page for what is left below the last line."""
    w = on_page()
    body = lines.select(
        *PAGE, "line_number", (F.col("top") - F.lag("bottom", 1, 0.0).over(w)).alias("unused"), (F.col("bottom") - F.col("top")).alias("used"), F.col("x0").alias("indent"),
        F.concat_ws(" ", "predominant_font", F.format_string("%.1f", "predominant_size")).alias("font"), F.substring("text", 1, 60).alias("preview"),
    )
    tail = lines.groupBy(*PAGE).agg((F.max("line_number") + 1).alias("line_number"), (F.max("page_height") - F.max("bottom")).alias("unused")).select(
        *PAGE, "line_number", "unused", F.lit(0.0).alias("used"), F.lit(None).cast("double").alias("indent"), F.lit(None).cast("string").alias("font"), F.lit("").alias("preview")
    )
    return body.unionByName(tail)


def region_histogram(found: DataFrame) -> DataFrame:
    """Lines by used height and indent, for each document and over all."""
    rows = found.where("indent IS NOT NULL").select("doc_id", "used", "indent")
    return rows.groupingSets([["doc_id", "used", "indent"], ["used", "indent"]], "doc_id", "used", "indent").agg(F.grouping("doc_id").cast("int").alias("overall"), F.count(F.lit(1)).alias("n"))
