"""The registered queries of the layout operators, each beside DuckDB SQL that
states the same result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.functions import scalar
from pagegrain.operators import answers, blocks, boundaries, checks, layout, patterns, results, sampling, spacing, tokens, words
from pagegrain.plans import analysis, provider, report, summary, workflow
from pagegrain.sources import adapters, records, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.layout_lines(table(spark, sf_dir, "documents"))


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spacing.with_gaps(lines_of(spark, sf_dir))


def rules_of(lines: DataFrame) -> DataFrame:
    return spacing.spacing_rules(spacing.gap_histogram(spacing.gap_samples(lines)))


def words_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.event_words(table(spark, sf_dir, "events"))


def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.grouped_lines(words_of(spark, sf_dir))


# Common table expressions of the oracles.
FONT_LIST = "[" + ", ".join(f"'{f}'" for f in adapters.FONTS) + "]"
LINES = f"""raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
lined AS (SELECT doc_id, CAST(pos // {adapters.LINES_PER_PAGE} + 1 AS INTEGER) AS page, CAST(pos % {adapters.LINES_PER_PAGE} + 1 AS INTEGER) AS line_number, text,
  CAST(10 + 2 * ((doc_id + length(text)) % 3) AS DOUBLE) AS predominant_size, {FONT_LIST}[(doc_id + length(text)) % 4 + 1] AS predominant_font,
  CAST(((3 + length(text) * 7 + pos * 3) % 11) * 0.75 AS DOUBLE) AS lead FROM raw),
placed AS (SELECT *, sum(lead + predominant_size) OVER (PARTITION BY doc_id, page ORDER BY line_number) AS bottom FROM lined),
lines AS (SELECT doc_id, page, line_number, text, predominant_size, predominant_font, CAST(72 + length(text) % 5 * 4.5 AS DOUBLE) AS x0, bottom - predominant_size AS top,
  CAST(72 + length(text) % 5 * 4.5 + length(text) * 4.5 AS DOUBLE) AS x1, bottom, 612.0::DOUBLE AS page_width, 792.0::DOUBLE AS page_height FROM placed)"""
W = "OVER (PARTITION BY doc_id, page ORDER BY line_number)"
GAPS = LINES + f""",
g AS (SELECT *, CASE WHEN row_number() {W} = 1 THEN top ELSE greatest(top - lag(bottom) {W}, 0) END AS gap_before,
  CASE WHEN lead(line_number) {W} IS NULL THEN page_height - bottom ELSE greatest(lead(top) {W} - bottom, 0) END AS gap_after FROM lines)"""
HIST = GAPS + """,
seq AS (SELECT *, row_number() OVER d AS pos, lag(predominant_size) OVER d AS previous FROM g WINDOW d AS (PARTITION BY doc_id ORDER BY page, line_number)),
hist AS (SELECT doc_id, predominant_size AS context_size, round_even(gap_before / 0.5, 0) * 0.5 AS gap, count(*) AS cnt, min(pos) AS first_pos FROM seq
  WHERE predominant_size = previous AND gap_before > 0.01 GROUP BY ALL)"""
RULES = HIST + """,
modal AS (SELECT doc_id, context_size, arg_max(gap, {'a': cnt, 'b': -first_pos}) AS most_common_gap, sum(cnt) AS total_gaps, min(first_pos) AS first_pos FROM hist GROUP BY ALL),
rules AS (SELECT *, most_common_gap * (1 - 0.2) AS line_lo, most_common_gap * (1 + 0.2) AS line_hi, context_size * 1.1 AS para_max FROM modal)"""
BLOCKS = RULES + f""",
b0 AS (SELECT g.*, r.line_hi FROM g LEFT JOIN rules r ON g.doc_id = r.doc_id AND g.predominant_size = r.context_size WHERE regexp_replace(text, '\\s+', '', 'g') <> ''),
b1 AS (SELECT *, CASE WHEN coalesce(lag(predominant_size) {W} = predominant_size AND gap_before <= line_hi, false) THEN 0 ELSE 1 END AS start FROM b0),
nl AS (SELECT *, CAST(sum(start) {W} AS INTEGER) AS block_no FROM b1),
blk AS (SELECT doc_id, page, block_no, min(predominant_size) AS predominant_size, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom,
  string_agg(text, chr(10) ORDER BY line_number) AS text, count(*) AS n_lines, arg_min(gap_before, line_number) AS first_gap, arg_max(gap_before, line_number) AS last_gap FROM nl GROUP BY ALL)"""
WORDS = f"""w AS (SELECT CAST(1 AS BIGINT) AS doc_id, CAST(user_id AS INTEGER) AS page, event_id AS word_seq, event_type || '-' || CAST(event_id % 97 AS VARCHAR) AS text,
  CAST(event_id * 37 % 500 AS DOUBLE) AS x0, event_id * 37 % 500 + event_id % 29 + 3.0::DOUBLE AS x1, value AS top, value + 10.0::DOUBLE AS bottom,
  {FONT_LIST}[event_id // 5 % 4 + 1] AS fontname, 9.0::DOUBLE + event_id // 7 % 3 * 1.25::DOUBLE AS size, event_id % 50 <> 0 AS upright FROM events)"""
WORD_LINES = WORDS + """,
o AS (SELECT page, top, row_number() OVER (PARTITION BY page ORDER BY top) AS i FROM (SELECT DISTINCT page, top FROM w)),
fold(page, i, anchor, line_number) AS (SELECT page, i, top, 1 FROM o WHERE i = 1 UNION ALL
  SELECT o.page, o.i, CASE WHEN abs(o.top - f.anchor) > 3 THEN o.top ELSE f.anchor END, f.line_number + CASE WHEN abs(o.top - f.anchor) > 3 THEN 1 ELSE 0 END FROM fold f JOIN o ON o.page = f.page AND o.i = f.i + 1),
wl AS (SELECT w.*, CAST(f.line_number AS INTEGER) AS line_number FROM w JOIN o ON w.page = o.page AND w.top = o.top JOIN fold f ON f.page = o.page AND f.i = o.i)"""
LW = "PARTITION BY doc_id, page, line_number ORDER BY x0, word_seq"
SEGMENTS = WORD_LINES + f""",
s0 AS (SELECT *, CASE WHEN lag(word_seq) OVER k IS NOT NULL AND lag(fontname) OVER k = fontname AND lag(size) OVER k = size AND lag(upright) OVER k = upright THEN 0 ELSE 1 END AS start FROM wl WINDOW k AS ({LW})),
s1 AS (SELECT *, CAST(sum(start) OVER ({LW}) AS INTEGER) AS seg_no FROM s0),
segs AS (SELECT doc_id, page, line_number, seg_no, arg_min(fontname, {{'a': x0, 'b': word_seq}}) AS font, arg_min(size, {{'a': x0, 'b': word_seq}}) AS reported_size,
  CASE WHEN arg_min(upright, {{'a': x0, 'b': word_seq}}) THEN 'upright' ELSE 'rotated' END AS direction, trim(string_agg(text, '' ORDER BY x0, word_seq)) AS text, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM s1 GROUP BY ALL),
seg AS (SELECT *, round_even(reported_size / 0.5, 0) * 0.5 AS rounded_size FROM segs)"""
PAGES = LINES + ", pages_ AS (SELECT DISTINCT doc_id, page FROM lines)"
RX = {n: r.replace("'", "''") for n, r, *_ in patterns.PATTERNS}
HEADED = """headed AS (
 SELECT 1::BIGINT AS doc_id, p_partkey AS line_number, CAST(p_partkey % 7 + 1 AS INTEGER) AS page, CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 9 AS VARCHAR) || ' ' || upper(left(p_name, 1)) || substr(p_name, 2) AS text FROM part
 UNION ALL SELECT 2, n_nationkey, CAST(n_nationkey % 5 + 1 AS INTEGER), 'Table ' || CAST(n_regionkey + 1 AS VARCHAR) || '-' || CAST(n_nationkey AS VARCHAR) || ': ' || n_name FROM nation
 UNION ALL SELECT 3, n_nationkey, CAST(n_nationkey % 5 + 1 AS INTEGER), 'Figure ' || CAST(n_nationkey AS VARCHAR) || ' – ' || n_name FROM nation
 UNION ALL SELECT 4, s_suppkey, CAST(s_suppkey % 4 + 1 AS INTEGER), CASE s_suppkey % 6 WHEN 0 THEN 'Page ' || CAST(s_suppkey AS VARCHAR) WHEN 1 THEN CAST(s_suppkey AS VARCHAR) || '.1 ' || s_name || ' ..... ' || CAST(s_suppkey % 90 AS VARCHAR)
   WHEN 2 THEN 'Annex ' || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) || ' of ' || s_name WHEN 3 THEN 'A.' || CAST(s_suppkey AS VARCHAR) || ' Overview' WHEN 4 THEN CAST(s_suppkey AS VARCHAR) ELSE '(iv) see Table 2-1 and Figure 3' END FROM supplier)"""


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, captions, entries and page numbers made of the star tables."""
    part, nation, supplier = (table(spark, sf_dir, t) for t in ("part", "nation", "supplier"))
    s = lambda c: F.col(c).cast("string")
    k = F.col("s_suppkey")
    kinds = [
        F.concat(F.lit("Page "), s("s_suppkey")), F.concat(s("s_suppkey"), F.lit(".1 "), "s_name", F.lit(" ..... "), (k % 90).cast("string")),
        F.concat(F.lit("Annex "), F.char(65 + k % 26), F.lit(" of "), "s_name"), F.concat(F.lit("A."), s("s_suppkey"), F.lit(" Overview")), s("s_suppkey"), F.lit("(iv) see Table 2-1 and Figure 3"),
    ]
    row = lambda d, doc, key, m, text: d.select(F.lit(doc).cast("bigint").alias("doc_id"), F.col(key).alias("line_number"), (F.col(key) % m + 1).cast("int").alias("page"), text.alias("text"))
    title = F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 1 << 30))
    return (
        row(part, 1, "p_partkey", 7, F.concat(s("p_size"), F.lit("."), (F.col("p_partkey") % 9).cast("string"), F.lit(" "), title))
        .unionByName(row(nation, 2, "n_nationkey", 5, F.concat(F.lit("Table "), (F.col("n_regionkey") + 1).cast("string"), F.lit("-"), s("n_nationkey"), F.lit(": "), "n_name")))
        .unionByName(row(nation, 3, "n_nationkey", 5, F.concat(F.lit("Figure "), s("n_nationkey"), F.lit(" – "), "n_name")))
        .unionByName(row(supplier, 4, "s_suppkey", 4, F.get(F.array(*kinds), (k % 6).cast("int"))))
    )


# Sources and blank lines


@query(f"WITH {LINES} SELECT * FROM lines")
def layout_lines(spark, sf_dir):
    return lines_of(spark, sf_dir)


@query(f"WITH {GAPS} SELECT doc_id, page, line_number, gap_before, gap_after FROM g")
def two_sided_gaps(spark, sf_dir):
    return gapped(spark, sf_dir).select("doc_id", "page", "line_number", "gap_before", "gap_after")


SHORT = "CASE WHEN length(text) % 4 = 0 THEN '  ' ELSE text END"


@query(f"""WITH {LINES}, k AS (SELECT * REPLACE ({SHORT} AS text) FROM lines), n AS (SELECT *, row_number() {W} AS rn FROM k WHERE trim(text) <> '')
SELECT doc_id, page, line_number AS original_line_number, CAST(rn AS INTEGER) AS line_number, CASE WHEN rn = 1 THEN top ELSE greatest(top - lag(bottom) {W}, 0) END AS gap_before,
  CASE WHEN lead(rn) {W} IS NULL THEN page_height - bottom ELSE greatest(lead(top) {W} - bottom, 0) END AS gap_after FROM n""")
def blank_lines_dropped(spark, sf_dir):
    lines = lines_of(spark, sf_dir).withColumn("text", F.when(F.length("text") % 4 == 0, "  ").otherwise(F.col("text")))
    return spacing.drop_blank(lines).select("doc_id", "page", "original_line_number", "line_number", "gap_before", "gap_after")


@query(f"WITH {PAGES} SELECT doc_id, page FROM pages_ WHERE page BETWEEN 2 AND 3")
def page_range(spark, sf_dir):
    return adapters.page_range(lines_of(spark, sf_dir), 2, 3).select("doc_id", "page").distinct()


@query("SELECT p AS page FROM (SELECT unnest([1, 2, 3, 5, 8, 9, 10]) AS p) WHERE p NOT IN (2, 9)")
def page_expression(spark, sf_dir):
    return adapters.page_set(spark, "1-3,5,8-10", 12, "2,9")


@query("""SELECT conv_id, CAST(turn + 1 AS INTEGER) AS page, CASE turn % 3 WHEN 0 THEN 'lines' WHEN 1 THEN 'blocks' ELSE 'text' END AS kind,
  unnest(range(CASE WHEN turn % 3 = 2 THEN len(string_split(text, chr(10))) ELSE 1 END))::INTEGER AS item_no, unnest(CASE WHEN turn % 3 = 2 THEN string_split(text, chr(10)) ELSE [text] END) AS item FROM conversations""")
def page_shapes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    body = (
        F.when(F.col("turn") % 3 == 0, F.to_json(F.struct((F.col("turn") + 1).alias("page"), F.array(F.struct("text")).alias("lines"))))
        .when(F.col("turn") % 3 == 1, F.to_json(F.struct((F.col("turn") + 1).alias("page"), F.array(F.struct(F.array("text").alias("text_lines"))).alias("blocks"))))
        .otherwise(F.to_json(F.struct((F.col("turn") + 1).alias("page_number"), "text")))
    )
    doc = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"pages":['), body, F.lit("]}"))).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    return adapters.page_records(rows.select("conv_id", doc.alias("json"))).select("conv_id", "page", "kind", "item_no", "item")


@query("""SELECT CAST(n_regionkey AS INTEGER) AS page, CAST(n_nationkey AS INTEGER) AS line_number, n_nationkey || '.1 ' || n_name || ' ' || repeat('.', least(30, 70 - length(n_nationkey || '.1 ' || n_name) - length(CAST(n_nationkey * 3 AS VARCHAR)))) || ' ' || n_nationkey * 3 AS text,
  CAST(72 + 20 * (n_nationkey % 3) AS DOUBLE) AS x0, CAST(100 + 15 * (n_nationkey - 1) AS DOUBLE) AS top FROM nation""")
def contents_page(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("int")
    return adapters.toc_page(n.select(F.col("n_regionkey").cast("int").alias("page"), key.alias("entry_no"), F.concat(key.cast("string"), F.lit(".1")).alias("number"), F.col("n_name").alias("title"), (key % 3 + 1).alias("level"), (key * 3).alias("target")))


@query("""SELECT CAST(n_nationkey AS INTEGER) AS page, 'image' AS type, n_nationkey * 1.0::DOUBLE AS x0, 1.0::DOUBLE AS y0, 2.0::DOUBLE AS x1, 3.0::DOUBLE AS y1, n_name AS metadata FROM nation
UNION ALL SELECT CAST(n_nationkey AS INTEGER), 'hyperlink', n_nationkey * 1.0, 1.0, 2.0, 3.0, 'u' || n_nationkey FROM nation WHERE n_nationkey % 2 = 1
UNION ALL SELECT CAST(r_regionkey AS INTEGER), 'rect', r_regionkey * 1.0, 1.0, 2.0, 3.0, NULL FROM region UNION ALL SELECT CAST(r_regionkey AS INTEGER), 'edge', r_regionkey * 1.0, 1.0, 2.0, 3.0, NULL FROM region""")
def page_objects(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    box = lambda k: [F.col(k).cast("int").alias("page"), (F.col(k) * 1.0).cast("double").alias("x0"), F.lit(1.0).alias("y0"), F.lit(2.0).alias("x1"), F.lit(3.0).alias("y1")]
    nothing = F.lit(None).cast("string")
    notes = n.select(*box("n_nationkey"), F.lit(" ").alias("title"), nothing.alias("contents"), F.when(F.col("n_nationkey") % 2 == 1, F.concat(F.lit("u"), F.col("n_nationkey").cast("string"))).alias("uri"), nothing.alias("subject"))
    shapes = r.select(*box("r_regionkey"), F.lit("rect").alias("type"))
    return adapters.objects(n.select(*box("n_nationkey"), F.col("n_name").alias("name")), notes, shapes, shapes.drop("type"))


# Spacing, rules, blocks


@query(f"WITH {HIST} SELECT doc_id, context_size, gap, cnt, CAST(first_pos AS INTEGER) AS first_pos FROM hist")
def gap_histogram(spark, sf_dir):
    return spacing.gap_histogram(spacing.gap_samples(gapped(spark, sf_dir)))


@query(f"WITH {LINES} SELECT doc_id, predominant_size AS context_size, count(*) AS n_lines FROM lines GROUP BY ALL")
def lines_per_size(spark, sf_dir):
    return spacing.lines_per_size(lines_of(spark, sf_dir))


@query(f"""WITH {RULES} SELECT r.doc_id, r.context_size, most_common_gap, line_lo, line_hi, para_max, CAST(total_gaps AS BIGINT) AS total_gaps, CAST(coalesce(sum(cnt) FILTER (gap <= line_hi), 0) AS BIGINT) AS line_gaps,
  CAST(coalesce(sum(cnt) FILTER (gap > line_hi AND gap <= para_max), 0) AS BIGINT) AS para_gaps, CAST(coalesce(sum(cnt) FILTER (gap > para_max), 0) AS BIGINT) AS section_gaps
FROM rules r JOIN hist h ON r.doc_id = h.doc_id AND r.context_size = h.context_size GROUP BY ALL""")
def spacing_rules(spark, sf_dir):
    return rules_of(gapped(spark, sf_dir)).drop("first_pos")


@query(f"WITH {BLOCKS} SELECT doc_id, page, block_no, predominant_size, x0, top, x1, bottom, text, n_lines FROM blk")
def block_table(spark, sf_dir):
    lines = gapped(spark, sf_dir)
    return blocks.blocks(blocks.numbered_lines(lines, rules_of(lines))).select("doc_id", "page", "block_no", "predominant_size", "x0", "top", "x1", "bottom", "text", "n_lines")


BW = "OVER (PARTITION BY doc_id, page ORDER BY block_no)"


@query(f"""WITH {BLOCKS} SELECT doc_id, page, block_no, coalesce(top - lag(bottom) {BW}, first_gap) AS gap_before, coalesce(lead(top) {BW} - bottom, CASE WHEN n_lines > 1 THEN last_gap ELSE 0 END) AS gap_after FROM blk""")
def block_gaps(spark, sf_dir):
    lines = gapped(spark, sf_dir)
    found = blocks.with_block_gaps(blocks.blocks(blocks.numbered_lines(lines, rules_of(lines))))
    return found.select("doc_id", "page", "block_no", "gap_before", "gap_after")


@query(f"""WITH {BLOCKS}, f AS (SELECT doc_id, page, block_no, predominant_font, count(*) AS n, min(line_number) AS at_ FROM nl GROUP BY ALL)
SELECT doc_id, page, block_no, arg_max(predominant_font, {{'a': n, 'b': -at_}}) AS predominant_font, max(n) / sum(n) AS font_coverage FROM f GROUP BY ALL""")
def block_fonts(spark, sf_dir):
    lines = gapped(spark, sf_dir)
    return blocks.blocks(blocks.numbered_lines(lines, rules_of(lines))).select("doc_id", "page", "block_no", "predominant_font", "font_coverage")


SEG_LIST = f"{FONT_LIST}[(doc_id + line_number) % 4 + 1]"


@query(f"""WITH {BLOCKS}, sg AS (SELECT doc_id, page, block_no, line_number, 1 AS seg_no, predominant_size AS rounded_size, predominant_font AS font FROM nl UNION ALL SELECT doc_id, page, block_no, line_number, 2, predominant_size + line_number % 2, {SEG_LIST} FROM nl WHERE line_number % 2 = 0 OR length(text) % 3 = 0),
s AS (SELECT doc_id, page, block_no, arg_min(rounded_size, {{'a': -n, 'b': f}}) AS v, max(n) AS n FROM (SELECT doc_id, page, block_no, rounded_size, count(*) AS n, min({{'a': line_number, 'b': seg_no}}) AS f FROM sg GROUP BY ALL) GROUP BY ALL),
f AS (SELECT doc_id, page, block_no, arg_min(font, {{'a': -n, 'b': f}}) AS v, max(n) AS n FROM (SELECT doc_id, page, block_no, font, count(*) AS n, min({{'a': line_number, 'b': seg_no}}) AS f FROM sg GROUP BY ALL) GROUP BY ALL), t AS (SELECT doc_id, page, block_no, count(*) AS k FROM sg GROUP BY ALL)
SELECT doc_id, page, block_no, s.v AS predominant_size, s.n / k AS size_coverage, f.v AS predominant_font, f.n / k AS font_coverage FROM t JOIN s USING (doc_id, page, block_no) JOIN f USING (doc_id, page, block_no)""")
def block_segment_metadata(spark, sf_dir):
    lines = gapped(spark, sf_dir)
    numbered = blocks.numbered_lines(lines, rules_of(lines))
    own = lines.select("doc_id", "page", "line_number", F.lit(1).alias("seg_no"), F.col("predominant_size").alias("rounded_size"), F.col("predominant_font").alias("font"))
    other = F.element_at(F.array(*[F.lit(f) for f in adapters.FONTS]), (F.pmod(F.col("doc_id") + F.col("line_number"), F.lit(4)) + 1).cast("int"))
    more = lines.where((F.col("line_number") % 2 == 0) | (F.length("text") % 3 == 0)).select("doc_id", "page", "line_number", F.lit(2).alias("seg_no"), (F.col("predominant_size") + F.col("line_number") % 2).alias("rounded_size"), other.alias("font"))
    return blocks.segment_metadata(numbered, own.unionByName(more))


@query(f"""WITH {BLOCKS}, l AS (SELECT doc_id, page, block_no, list(trim(text) ORDER BY line_number) AS t, min(top) AS y0, min(x0) AS x0, min(predominant_size) AS font_size FROM nl GROUP BY ALL)
SELECT doc_id, page, block_no, array_to_string(list_filter(t, lambda x: x <> ''), '|') AS lines, y0, x0, font_size FROM l""")
def streamlined_blocks(spark, sf_dir):
    lines = gapped(spark, sf_dir)
    found = blocks.streamlined(blocks.blocks(blocks.numbered_lines(lines, rules_of(lines))))
    return found.select("doc_id", "page", "block_no", F.array_join("text_lines", "|").alias("lines"), "y0", "x0", "font_size")


@query(f"""WITH {GAPS}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_number) AS pos FROM g), h AS (SELECT doc_id, round_even(gap_before / 0.5, 0) * 0.5 AS gap, count(*) AS cnt, min(pos) AS fp FROM s WHERE gap_before > 0 GROUP BY ALL),
m AS (SELECT doc_id, arg_max(gap, {{'a': gap > 0.01, 'b': cnt, 'c': -fp}}) AS m FROM h GROUP BY ALL) SELECT h.doc_id, m AS most_common_gap, gap, cnt, gap > m * 1.3 AND gap < m * 1.8 * 1.5 AS paragraph FROM h JOIN m ON h.doc_id = m.doc_id""")
def line_spacing(spark, sf_dir):
    histogram, common = spacing.line_spacing(gapped(spark, sf_dir))
    marks = spacing.paragraph_candidates(histogram, common).select("doc_id", "gap", F.lit(True).alias("paragraph"))
    return histogram.join(common, "doc_id").join(marks, ["doc_id", "gap"], "left").select("doc_id", "most_common_gap", "gap", "cnt", F.coalesce("paragraph", F.lit(False)).alias("paragraph"))


@query(f"""WITH {GAPS}, s AS (SELECT *, row_number() {W} AS pos, lag(predominant_size) {W} AS previous FROM g),
h AS (SELECT doc_id, page, predominant_size AS c, round_even(gap_before / 0.5, 0) * 0.5 AS gap, count(*) AS cnt, min(pos) AS fp FROM s WHERE predominant_size = previous AND gap_before > 0.01 GROUP BY ALL),
r AS (SELECT doc_id, page, c, arg_max(gap, {{'a': cnt, 'b': -fp}}) * 1.2 AS hi, c * 1.1 AS mx, sum(cnt) AS n, min(fp) AS fp FROM h GROUP BY ALL), b AS (SELECT doc_id, page, arg_max({{'hi': hi, 'mx': mx}}, {{'a': n, 'b': -fp}}) AS b FROM r GROUP BY ALL),
t AS (SELECT s.doc_id, gap_before, coalesce(r.hi, b.b.hi) AS hi, coalesce(r.mx, b.b.mx) AS mx, round_even(gap_before / 0.5, 0) * 0.5 AS q FROM s LEFT JOIN r ON s.doc_id = r.doc_id AND s.page = r.page AND s.predominant_size = r.c LEFT JOIN b ON s.doc_id = b.doc_id AND s.page = b.page WHERE pos > 1 AND gap_before > 0),
k AS (SELECT *, CASE WHEN hi IS NULL OR q <= hi THEN 'Line' WHEN q <= mx THEN 'Paragraph' ELSE 'Section' END AS kind FROM t)
SELECT doc_id, count(*) FILTER (kind = 'Paragraph') AS paragraph_gaps, coalesce(avg(gap_before) FILTER (kind = 'Paragraph'), 0) AS paragraph_avg, count(*) FILTER (kind = 'Section') AS section_gaps, coalesce(avg(gap_before) FILTER (kind = 'Section'), 0) AS section_avg FROM k GROUP BY ALL""")
def paragraph_spacing(spark, sf_dir):
    return spacing.paragraph_spacing(gapped(spark, sf_dir))


# Header and footer boundaries

ZONES = f""",
z AS (SELECT g.*, lead(top) {W} AS next_top, lag(bottom) {W} AS previous_bottom, top < 90 AS in_header, bottom > 792 - 72 AS in_footer FROM g)"""
TRADITIONAL = ZONES + """,
bs AS (SELECT doc_id, page, arg_max(gap_before, {'a': gap_before > 0.01, 'b': n, 'c': -f}) AS base FROM (SELECT doc_id, page, gap_before, count(*) AS n, min(line_number) AS f FROM g WHERE gap_before > 0 GROUP BY ALL) GROUP BY ALL),
tr AS (SELECT z.*, coalesce(base, 0) * 1.8 AS least FROM z LEFT JOIN bs ON z.doc_id = bs.doc_id AND z.page = bs.page),
trad AS (SELECT doc_id, page, 'header' AS target, bottom AS y_coord, text, next_top - bottom AS gap, 'traditional' AS method FROM tr WHERE in_header AND next_top - bottom >= least
  UNION ALL SELECT doc_id, page, 'footer', top, text, top - previous_bottom, 'traditional' FROM tr WHERE in_footer AND top - previous_bottom >= least)"""
CONTEXTUAL = """,
best AS (SELECT doc_id, arg_max({'hi': line_hi, 'mx': para_max}, {'a': total_gaps, 'b': -first_pos}) AS b FROM rules GROUP BY ALL),
cx AS (SELECT z.*, coalesce(r.line_hi, best.b.hi) AS hi, coalesce(r.para_max, best.b.mx) AS mx FROM z LEFT JOIN rules r ON z.doc_id = r.doc_id AND z.predominant_size = r.context_size LEFT JOIN best ON z.doc_id = best.doc_id),
ctx AS (SELECT doc_id, page, 'header' AS target, bottom AS y_coord, text, gap_after AS gap, 'contextual' AS method FROM cx WHERE in_header AND next_top IS NOT NULL AND round_even(gap_after / 0.5, 0) * 0.5 > hi AND round_even(gap_after / 0.5, 0) * 0.5 > mx
  UNION ALL SELECT doc_id, page, 'footer', top, text, gap_before, 'contextual' FROM cx WHERE in_footer AND previous_bottom IS NOT NULL AND round_even(gap_before / 0.5, 0) * 0.5 > hi AND round_even(gap_before / 0.5, 0) * 0.5 > mx)"""


@query(f"WITH {GAPS}{TRADITIONAL} SELECT * FROM trad")
def header_footer_traditional(spark, sf_dir):
    return boundaries.traditional(gapped(spark, sf_dir))


@query(f"WITH {RULES}{ZONES}{CONTEXTUAL} SELECT * FROM ctx")
def header_footer_contextual(spark, sf_dir):
    lines = gapped(spark, sf_dir)
    return boundaries.contextual(lines, rules_of(lines))


@query(f"""WITH {RULES}{TRADITIONAL}{CONTEXTUAL}, allc AS (SELECT * FROM trad UNION ALL SELECT * FROM ctx), cc AS (SELECT doc_id, method, target, y_coord, count(*) AS n, min(page) AS p FROM allc GROUP BY ALL),
md AS (SELECT doc_id, method, target, arg_max(y_coord, {{'a': n, 'b': -p, 'c': CASE target WHEN 'header' THEN -y_coord ELSE y_coord END}}) AS y FROM cc GROUP BY ALL), dd AS (SELECT doc_id, max(bottom) AS lowest FROM g GROUP BY ALL)
SELECT dd.doc_id, m.method, coalesce(h.y, 0) AS final_header_bottom, coalesce(f.y, lowest) AS final_footer_top FROM dd, (VALUES ('traditional'), ('contextual')) m(method)
LEFT JOIN md h ON h.doc_id = dd.doc_id AND h.method = m.method AND h.target = 'header' LEFT JOIN md f ON f.doc_id = dd.doc_id AND f.method = m.method AND f.target = 'footer'""")
def final_boundaries(spark, sf_dir):
    lines = gapped(spark, sf_dir)
    found = boundaries.traditional(lines).unionByName(boundaries.contextual(lines, rules_of(lines)))
    return boundaries.final_boundaries(lines, found)


@query(f"""WITH RECURSIVE {GAPS}, bs AS (SELECT doc_id, page, arg_max(gap_before, {{'a': gap_before > 0.01, 'b': n, 'c': -f}}) AS base FROM (SELECT doc_id, page, gap_before, count(*) AS n, min(line_number) AS f FROM g WHERE gap_before > 0 GROUP BY ALL) GROUP BY ALL),
k AS (SELECT g.doc_id, g.page, top, bottom, row_number() OVER v AS i, row_number() OVER d AS j, lead(top) OVER v - bottom AS down, top - lag(bottom) OVER v AS up, base FROM g JOIN bs ON g.doc_id = bs.doc_id AND g.page = bs.page WHERE trim(text) <> '' WINDOW v AS (PARTITION BY g.doc_id, g.page ORDER BY line_number), d AS (PARTITION BY g.doc_id, g.page ORDER BY line_number DESC)),
hs(doc_id, page, i, found, done) AS (SELECT doc_id, page, 0, CAST(NULL AS DOUBLE), false FROM (SELECT DISTINCT doc_id, page FROM k) UNION ALL
  SELECT k.doc_id, k.page, k.i, CASE WHEN k.top >= 90 OR down IS NULL THEN found WHEN down >= 1.8 * base THEN k.bottom WHEN down < 1.3 * base THEN found ELSE k.bottom END, k.top >= 90 OR down IS NULL OR down >= 1.8 * base FROM hs JOIN k ON k.doc_id = hs.doc_id AND k.page = hs.page AND k.i = hs.i + 1 WHERE NOT done),
fs(doc_id, page, j, found, done) AS (SELECT doc_id, page, 0, CAST(NULL AS DOUBLE), false FROM (SELECT DISTINCT doc_id, page FROM k) UNION ALL
  SELECT k.doc_id, k.page, k.j, CASE WHEN k.bottom <= 720 OR up IS NULL THEN found WHEN up >= 1.8 * base THEN k.top WHEN up < 1.3 * base THEN found ELSE k.top END, k.bottom <= 720 OR up IS NULL OR up >= 1.8 * base FROM fs JOIN k ON k.doc_id = fs.doc_id AND k.page = fs.page AND k.j = fs.j + 1 WHERE NOT done)
SELECT h.doc_id, h.page, h.found AS header_bottom, f.found AS footer_top FROM (SELECT doc_id, page, arg_max_null(found, i) AS found FROM hs GROUP BY ALL) h JOIN (SELECT doc_id, page, arg_max_null(found, j) AS found FROM fs GROUP BY ALL) f ON h.doc_id = f.doc_id AND h.page = f.page""")
def header_footer_scan(spark, sf_dir):
    return boundaries.scanned(gapped(spark, sf_dir))


@query(f"""WITH {RULES}{ZONES}{CONTEXTUAL}, {BLOCKS[len(RULES) + 2:]},
p AS (SELECT doc_id, count(DISTINCT page) AS n_pages, min(page_width) AS page_width, min(page_height) AS page_height FROM g GROUP BY ALL),
fk AS (SELECT doc_id, split_part(predominant_font, '-', 1) || '|' || CAST(predominant_size AS VARCHAR) || '|' || CASE WHEN predominant_font LIKE '%BoldItalic%' THEN 'Bold+Italic' WHEN predominant_font LIKE '%Bold%' THEN 'Bold' ELSE 'Regular' END AS k, count(*) AS n, min({{'a': page, 'b': line_number}}) AS f FROM g GROUP BY ALL),
bf AS (SELECT doc_id, arg_min(k, {{'a': -n, 'b': f}}) AS body_font, count(*) AS n_fonts FROM fk GROUP BY ALL),
sp AS (SELECT doc_id, round_even(gap_before / 0.5, 0) * 0.5 AS gap, count(*) AS cnt, min(page * 1000 + line_number) AS fp FROM g WHERE gap_before > 0 GROUP BY ALL), mc AS (SELECT doc_id, arg_max(gap, {{'a': gap > 0.01, 'b': cnt, 'c': -fp}}) AS most_common_gap FROM sp GROUP BY ALL),
nb AS (SELECT doc_id, count(*) AS n_blocks FROM blk GROUP BY ALL), cc AS (SELECT doc_id, target, y_coord, count(*) AS n, min(page) AS p FROM ctx GROUP BY ALL), md AS (SELECT doc_id, target, arg_max(y_coord, {{'a': n, 'b': -p, 'c': CASE target WHEN 'header' THEN -y_coord ELSE y_coord END}}) AS y FROM cc GROUP BY ALL), dd AS (SELECT doc_id, max(bottom) AS lowest FROM g GROUP BY ALL)
SELECT p.doc_id, n_pages, page_width, page_height, body_font, n_fonts, most_common_gap, coalesce(n_blocks, 0) AS n_blocks, coalesce(h.y, 0) AS final_header_bottom, coalesce(f.y, lowest) AS final_footer_top
FROM p JOIN bf USING (doc_id) JOIN dd USING (doc_id) LEFT JOIN mc USING (doc_id) LEFT JOIN nb USING (doc_id) LEFT JOIN md h ON h.doc_id = p.doc_id AND h.target = 'header' LEFT JOIN md f ON f.doc_id = p.doc_id AND f.target = 'footer'""")
def document_summary(spark, sf_dir):
    return summary.document_summary(lines_of(spark, sf_dir))


# Fonts and patterns


@query(f"""WITH {LINES}, k AS (SELECT doc_id, page, split_part(predominant_font, '-', 1) || '|' || CAST(predominant_size AS VARCHAR) || '|' || CASE WHEN predominant_font LIKE '%BoldItalic%' THEN 'Bold+Italic' WHEN predominant_font LIKE '%Bold%' THEN 'Bold' ELSE 'Regular' END AS font_key FROM lines)
SELECT doc_id, font_key, count(*) AS total, count(DISTINCT page) AS n_pages, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS share FROM k GROUP BY doc_id, font_key""")
def font_usage(spark, sf_dir):
    return patterns.font_usage(lines_of(spark, sf_dir)).drop("_first")


@query(f"WITH {LINES} SELECT predominant_font, string_agg(DISTINCT printf('%.1f', predominant_size), ',' ORDER BY printf('%.1f', predominant_size)) AS sizes FROM lines GROUP BY ALL")
def sizes_per_font(spark, sf_dir):
    return words.sizes_per_font(lines_of(spark, sf_dir))


SCAN = " UNION ALL ".join(
    f"SELECT doc_id, page, line_number, '{n}' AS pattern_name, unnest(regexp_extract_all(text, '{r}', 0)) AS match, unnest(regexp_extract_all(text, '{r}', 1)) AS number, unnest(range(len(regexp_extract_all(text, '{r}', 0)))) AS match_no FROM headed" for n, r in RX.items()
)
CATALOGUE = "cat(name, pattern_type, hierarchy_level) AS (VALUES " + ", ".join(f"('{n}', '{t}', {'NULL' if lvl is None else lvl})" for n, _, t, lvl in patterns.PATTERNS) + ")"


@query(f"WITH {HEADED}, m AS ({SCAN}) SELECT doc_id, page, line_number, pattern_name, CAST(match_no AS INTEGER) AS match_no, match, number FROM m")
def pattern_scan(spark, sf_dir):
    return patterns.scan(headed(spark, sf_dir))


@query(f"WITH {LINES.replace('lines AS', 'headed AS')}, m AS ({SCAN}) SELECT pattern_name, count(*) AS n FROM m GROUP BY ALL")
def pattern_scan_documents(spark, sf_dir):
    return patterns.scan(lines_of(spark, sf_dir)).groupBy("pattern_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {HEADED}, m AS ({SCAN}), {CATALOGUE} SELECT name, pattern_type, count(m.match) AS matches, count(DISTINCT (m.doc_id, m.page)) FILTER (m.doc_id IS NOT NULL) AS pages FROM cat LEFT JOIN m ON name = pattern_name GROUP BY ALL")
def pattern_statistics(spark, sf_dir):
    return patterns.statistics(patterns.scan(headed(spark, sf_dir)), patterns.catalogue(spark))


@query(f"""WITH {HEADED}, m AS ({SCAN}), {CATALOGUE}, s AS (SELECT name, count(m.match) AS k FROM cat LEFT JOIN m ON name = pattern_name WHERE pattern_type LIKE 'toc%' GROUP BY ALL)
SELECT count(*) FILTER (k > 0) AS hits, CAST(sum(k) AS BIGINT) AS matches, CASE WHEN sum(k) > 0 THEN least(count(*) FILTER (k > 0) / count(*) + least(sum(k) / 50, 0.3), 1) ELSE 0 END AS confidence FROM s""")
def pattern_confidence(spark, sf_dir):
    return patterns.confidence(patterns.statistics(patterns.scan(headed(spark, sf_dir)), patterns.catalogue(spark)), "toc")


@query(f"WITH {CATALOGUE} SELECT pattern_type, count(*) AS n, count(hierarchy_level) AS levels FROM cat GROUP BY ALL")
def pattern_catalogue(spark, sf_dir):
    return patterns.catalogue(spark).groupBy("pattern_type").agg(F.count(F.lit(1)).alias("n"), F.count("hierarchy_level").alias("levels"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', {i}, '{n}')" for s, ns in patterns.SETS.items() for i, n in enumerate(ns)) + ") t(set_name, ord, name)")
def pattern_set_members(spark, sf_dir):
    known = patterns.catalogue(spark).select("name")
    return patterns.pattern_sets(spark).join(F.broadcast(known), "name").select("set_name", "ord", "name")


@query(f"""WITH {HEADED} SELECT doc_id, page, line_number, 'chapter_pattern' AS pattern_name, 0 AS match_no, regexp_extract(text, '^(Table|Figure)', 0) AS match, regexp_extract(text, '^(Table|Figure)', 1) AS number FROM headed WHERE regexp_matches(text, '^(Table|Figure)')""")
def rescan_with_patterns(spark, sf_dir):
    extra = patterns.merged(patterns.PATTERNS, [("chapter_pattern", "^(Table|Figure)", "section", 1)])
    return patterns.scan(headed(spark, sf_dir), [p for p in extra if p[0] == "chapter_pattern"])


# Words


@query(f"WITH RECURSIVE {WORD_LINES} SELECT page, word_seq, line_number FROM wl")
def words_to_lines(spark, sf_dir):
    return word_lines(spark, sf_dir).select("page", "word_seq", "line_number")


@query(f"""WITH RECURSIVE {WORDS}, o AS (SELECT page, top, word_seq, row_number() OVER (PARTITION BY page ORDER BY word_seq) AS i FROM w), fold(page, i, anchor, n) AS (SELECT page, i, top, 1 FROM o WHERE i = 1 UNION ALL
  SELECT o.page, o.i, CASE WHEN abs(o.top - anchor) > 5 THEN o.top ELSE anchor END, n + CASE WHEN abs(o.top - anchor) > 5 THEN 1 ELSE 0 END FROM fold f JOIN o ON o.page = f.page AND o.i = f.i + 1)
SELECT o.page, word_seq, CAST(n AS INTEGER) AS line_number FROM fold JOIN o ON o.page = fold.page AND o.i = fold.i""")
def words_to_lines_flow(spark, sf_dir):
    return words.grouped_lines(words_of(spark, sf_dir), 5.0, flow_order=True).select("page", "word_seq", "line_number")


@query(f"""WITH RECURSIVE {WORD_LINES}, c AS (SELECT *, CASE WHEN abs(x0 - lag(x1) OVER ({LW})) <= 3 THEN 0 ELSE 1 END AS start FROM wl), d AS (SELECT *, CAST(sum(start) OVER ({LW}) AS INTEGER) AS part FROM c)
SELECT doc_id, page, line_number, part, string_agg(text, '' ORDER BY x0, word_seq) AS text, min(x0) AS x0, arg_max(x1, {{'a': x0, 'b': word_seq}}) AS x1 FROM d GROUP BY ALL""")
def combined_words(spark, sf_dir):
    return words.combined_words(word_lines(spark, sf_dir))


@query(f"WITH RECURSIVE {SEGMENTS} SELECT doc_id, page, line_number, seg_no, font, reported_size, rounded_size, direction, text, x0, top, x1, bottom FROM seg")
def text_segments(spark, sf_dir):
    return words.segments(word_lines(spark, sf_dir))


@query(f"""WITH RECURSIVE {SEGMENTS}, t AS (SELECT doc_id, page, line_number, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom, sum(x1 - x0) AS total FROM seg GROUP BY ALL),
a AS (SELECT doc_id, page, line_number, arg_max(rounded_size, {{'a': w, 'b': -s}}) AS v, max(w) AS w FROM (SELECT doc_id, page, line_number, rounded_size, sum(x1 - x0) AS w, min(seg_no) AS s FROM seg GROUP BY ALL) GROUP BY ALL),
b AS (SELECT doc_id, page, line_number, arg_max(font, {{'a': w, 'b': -s}}) AS v, max(w) AS w FROM (SELECT doc_id, page, line_number, font, sum(x1 - x0) AS w, min(seg_no) AS s FROM seg GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, page, line_number, x0, top, x1, bottom, a.v AS predominant_size, a.w / total * 100 AS predominant_size_coverage, b.v AS predominant_font, b.w / total * 100 AS predominant_font_coverage FROM t JOIN a USING (doc_id, page, line_number) JOIN b USING (doc_id, page, line_number)""")
def predominant_fonts(spark, sf_dir):
    return words.predominant(words.segments(word_lines(spark, sf_dir)))


@query(f"""WITH RECURSIVE {SEGMENTS}, n AS (SELECT *, x0 - lag(x1) OVER k AS gap, lag(rounded_size) OVER k * 0.3 AS space FROM seg WHERE text <> '' WINDOW k AS (PARTITION BY doc_id, page, line_number ORDER BY seg_no)),
p AS (SELECT *, CASE WHEN gap IS NOT NULL THEN greatest(1, CAST(round_even(gap / space, 0) AS INTEGER)) END AS k FROM n)
SELECT doc_id, page, line_number, string_agg(text, ' ' ORDER BY seg_no) AS text, string_agg(CASE WHEN k IS NULL THEN '' ELSE repeat(' ', k) END || text, '' ORDER BY seg_no) AS text_proportional, count(k) AS n_gaps FROM p GROUP BY ALL""")
def proportional_text(spark, sf_dir):
    out = words.proportional_text(words.segments(word_lines(spark, sf_dir)))
    return out.select("doc_id", "page", "line_number", "text", "text_proportional", F.size("spacing_info").cast("bigint").alias("n_gaps"))


COMPARE = f"""{LINES}, a AS (SELECT doc_id, page, line_number, text FROM lines), b AS (SELECT doc_id, page, line_number, trim(text) AS text FROM lines WHERE line_number < 6), c AS (SELECT doc_id, page, line_number, text FROM lines WHERE line_number % 2 = 0),
cmp AS (SELECT doc_id, page, line_number, a.text AS text, b.text AS lines, c.text AS words FROM a FULL JOIN b USING (doc_id, page, line_number) FULL JOIN c USING (doc_id, page, line_number))"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir)
    return words.compared(lines, lines.where("line_number < 6").withColumn("text", F.trim("text")), lines.where("line_number % 2 = 0"))


@query(f"WITH {COMPARE} SELECT * FROM cmp")
def compared_methods(spark, sf_dir):
    return _compared(spark, sf_dir)


@query(f"""WITH {COMPARE}, p AS (SELECT count(DISTINCT (doc_id, page)) AS p FROM cmp) SELECT count(*) FILTER (len(list_distinct([text, lines, words])) > 1) AS differing, count(text) / any_value(p) AS text_per_page, count(lines) / any_value(p) AS lines_per_page, count(words) / any_value(p) AS words_per_page FROM cmp, p""")
def differing_methods(spark, sf_dir):
    return words.differing(_compared(spark, sf_dir))


@query(f"""WITH {COMPARE}, {WORDS} SELECT (SELECT count(DISTINCT (doc_id, page)) FROM lines) AS pages, (SELECT count(*) FROM lines) AS lines, (SELECT count(*) FROM w) AS words, count(text) AS by_text, count(lines) AS by_lines, count(words) AS by_words FROM cmp""")
def extraction_info(spark, sf_dir):
    return sinks.info(lines_of(spark, sf_dir), words_of(spark, sf_dir), _compared(spark, sf_dir))


@query(f"WITH {WORDS} SELECT doc_id, page, word_seq, bottom - top AS height, top - lag(top, 1, 0) OVER k AS y0_dist, top - lag(bottom, 1, 0) OVER k AS y_gap FROM w WINDOW k AS (PARTITION BY page ORDER BY top, word_seq)")
def word_distances(spark, sf_dir):
    return words.word_distances(words_of(spark, sf_dir))


@query(f"""WITH {WORDS}, c AS (SELECT *, CASE WHEN word_seq % 6 = 0 THEN ' ' ELSE 'x' END AS ch FROM w), f AS (SELECT *, coalesce(last_value(CASE WHEN ch <> ' ' THEN fontname END IGNORE NULLS) OVER (PARTITION BY page ORDER BY word_seq ROWS UNBOUNDED PRECEDING), fontname) AS ft FROM c),
n AS (SELECT *, CASE WHEN lag(ft) OVER (PARTITION BY page ORDER BY word_seq) = ft THEN 0 ELSE 1 END AS start FROM f), r AS (SELECT *, CAST(sum(start) OVER (PARTITION BY page ORDER BY word_seq) AS INTEGER) AS run FROM n)
SELECT doc_id, page, run, ft AS font, string_agg(ch, '' ORDER BY word_seq) AS text, count(*) AS n FROM r GROUP BY ALL""")
def font_runs(spark, sf_dir):
    chars = words_of(spark, sf_dir).withColumn("text", F.when(F.col("word_seq") % 6 == 0, " ").otherwise("x")).withColumnRenamed("word_seq", "char_seq")
    return words.font_runs(chars)


@query(f"""WITH {WORDS} SELECT unnest(['text', 'upright', 'tall']) AS attribute, unnest([count(text), count(CASE WHEN upright THEN 1 END), count(CASE WHEN size > 10 THEN 1 END)]) AS n, unnest([count(text), count(CASE WHEN upright THEN 1 END), count(CASE WHEN size > 10 THEN 1 END)]) * 100.0::DOUBLE / count(*) AS percent FROM w""")
def attribute_counts(spark, sf_dir):
    w = words_of(spark, sf_dir).select("text", F.when(F.col("upright"), 1).alias("upright"), F.when(F.col("size") > 10, 1).alias("tall"))
    return words.attribute_counts(w, ["text", "upright", "tall"])


# Layout


RANGES = "-3,4-6.5,5-8,9,20-"


@query(f"""WITH {GAPS} SELECT doc_id, page, line_number, CAST(CASE WHEN gap_before <= 3 THEN 1 WHEN gap_before BETWEEN 4 AND 6.5 THEN 2 WHEN gap_before BETWEEN 5 AND 8 THEN 3 WHEN gap_before = 9 THEN 4 WHEN gap_before >= 20 THEN 5 END AS INTEGER) AS range_no FROM g""")
def matched_ranges(spark, sf_dir):
    found = layout.matched_range(gapped(spark, sf_dir), "gap_before", layout.parse_ranges(RANGES))
    return found.select("doc_id", "page", "line_number", "range_no")


@query("SELECT CAST(r AS INTEGER) AS range_no, l AS label FROM (VALUES (1, '≤ 3.00'), (2, '4.00 - 6.50'), (3, '5.00 - 8.00'), (4, '9.00'), (5, '≥ 20.00')) t(r, l)")
def range_labels(spark, sf_dir):
    rows = spark.createDataFrame(layout.parse_ranges(RANGES), "range_no int, low double, high double")
    return rows.select("range_no", scalar.range_label(F.col("low"), F.col("high")).alias("label"))


OCCUR = LINES + f""", o AS (SELECT doc_id, CASE WHEN lag(bottom) {W} IS NULL THEN top ELSE top - lag(bottom) {W} END AS gap FROM lines UNION ALL SELECT doc_id, page_height - max(bottom) FROM lines GROUP BY doc_id, page, page_height),
occ AS (SELECT doc_id, round_even(gap / 0.5, 0) * 0.5 AS spacing, count(*) AS n FROM o WHERE gap > 0 GROUP BY ALL)"""


@query(f"WITH {OCCUR} SELECT * FROM occ")
def spacing_occurrences(spark, sf_dir):
    return layout.spacing_occurrences(lines_of(spark, sf_dir))


COLOR_LIST = "[" + ", ".join(f"'{c}'" for c in layout.RANKED_COLORS) + "]"


@query(f"""WITH {OCCUR}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, spacing) AS k FROM occ) SELECT doc_id, spacing, n, CAST(k AS INTEGER) AS rank, coalesce({COLOR_LIST}[k], 'red') AS color,
  ['solid', 'dashed', 'dotted', 'dashdot', 'dashed', 'dotted', 'dashdot'][(k - 1) % 77 // 11 + 1] AS style, 1 + 0.5::DOUBLE * ((k - 1) % 77 % 11) AS width FROM r""")
def ranked_styles(spark, sf_dir):
    return layout.ranked_styles(layout.spacing_occurrences(lines_of(spark, sf_dir)))


@query(f"WITH {OCCUR}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, spacing) AS k FROM occ) SELECT doc_id, CAST(k AS INTEGER) AS rank, spacing, CAST((k - 1) // 40 AS INTEGER) AS legend_page, CAST((k - 1) % 40 AS INTEGER) AS legend_row FROM r")
def legend_rows(spark, sf_dir):
    return layout.legend_rows(layout.ranked_styles(layout.spacing_occurrences(lines_of(spark, sf_dir))))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {r}::DOUBLE, {g}::DOUBLE, {b}::DOUBLE)" for n, (r, g, b) in layout.COLORS.items()) + ") t(name, red, green, blue)")
def color_table(spark, sf_dir):
    return layout.colors(spark)


@query(f"WITH {LINES} SELECT doc_id, page, min(x0) AS left, max(page_width) - max(x1) AS right, min(top) AS top, max(page_height) - max(bottom) AS bottom FROM lines GROUP BY doc_id, page")
def page_margins(spark, sf_dir):
    return layout.margins(lines_of(spark, sf_dir))


REGION = LINES + f""", reg AS (SELECT doc_id, page, line_number, top - lag(bottom, 1, 0) {W} AS unused, bottom - top AS used, x0 AS indent, predominant_font || ' ' || printf('%.1f', predominant_size) AS font, left(text, 60) AS preview FROM lines
  UNION ALL SELECT doc_id, page, max(line_number) + 1, max(page_height) - max(bottom), 0, NULL, NULL, '' FROM lines GROUP BY doc_id, page)"""


@query(f"WITH {REGION} SELECT * FROM reg")
def vertical_regions(spark, sf_dir):
    return layout.regions(lines_of(spark, sf_dir))


@query(f"WITH {REGION} SELECT doc_id, used, indent, CAST(grouping(doc_id) AS INTEGER) AS overall, count(*) AS n FROM reg WHERE indent IS NOT NULL GROUP BY GROUPING SETS ((doc_id, used, indent), (used, indent))")
def region_histogram(spark, sf_dir):
    return layout.region_histogram(layout.regions(lines_of(spark, sf_dir)))


# Sampling


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir).select("doc_id", "page").distinct()


def _picked(within: str = "", seed: int = 42) -> str:
    return f"row_number() OVER (PARTITION BY doc_id{within} ORDER BY md5('{seed}:' || doc_id || ':' || page), page)"


@query(f"WITH {PAGES} SELECT doc_id, page FROM pages_ WHERE page <= 2 UNION ALL SELECT doc_id, page FROM (SELECT *, {_picked()} AS r FROM pages_ WHERE page > 2) WHERE r <= 3")
def sample_first_and_random(spark, sf_dir):
    return sampling.first_and_random(_pages(spark, sf_dir), 2, 3)


@query(f"WITH {PAGES}, n AS (SELECT doc_id, count(*) AS n FROM pages_ GROUP BY ALL) SELECT doc_id, page FROM pages_ WHERE page <= 3 UNION ALL SELECT doc_id, page FROM (SELECT p.*, {_picked()} AS r FROM pages_ p WHERE page > 3) JOIN n USING (doc_id) WHERE r <= greatest(1, (n - 3) // 10)")
def sample_contents(spark, sf_dir):
    return sampling.contents_sample(_pages(spark, sf_dir), 3)


@query(f"""WITH {PAGES}, n AS (SELECT doc_id, count(*) AS n FROM pages_ GROUP BY ALL), t AS (SELECT doc_id, page, greatest(10, floor(n * 0.15::DOUBLE)) AS target, CASE WHEN page <= n // 3 THEN 0 WHEN page <= n * 2 // 3 THEN 1 ELSE 2 END AS third FROM pages_ JOIN n USING (doc_id)),
q AS (SELECT *, floor(target * 0.6::DOUBLE) AS early, floor(target * 0.3::DOUBLE) AS middle FROM t)
SELECT doc_id, page, third FROM (SELECT *, {_picked(', third')} AS r FROM q) WHERE r <= CASE third WHEN 0 THEN early WHEN 1 THEN middle ELSE target - early - middle END""")
def sample_sections(spark, sf_dir):
    return sampling.sections_sample(_pages(spark, sf_dir))


@query(f"""WITH {PAGES}, n AS (SELECT doc_id, max(page) AS n FROM pages_ GROUP BY ALL HAVING max(page) > 5), o AS (SELECT doc_id, unnest(range(0, n - 4 + 1)) AS at_ FROM n),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42:' || doc_id || ':' || at_), at_) AS r FROM o), k AS (SELECT doc_id, at_, row_number() OVER (PARTITION BY doc_id ORDER BY at_) AS g FROM d WHERE r <= 2),
runs AS (SELECT doc_id, CAST(at_ + (g - 1) * 2 + 1 + i AS INTEGER) AS page, 'group' AS kind, CAST(g AS INTEGER) AS group_no FROM k, (VALUES (0), (1)) v(i)),
rest AS (SELECT p.* FROM pages_ p JOIN n USING (doc_id) WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM runs))
SELECT * FROM runs UNION ALL SELECT doc_id, page, 'individual', NULL FROM (SELECT *, {_picked(seed=43)} AS r FROM rest) WHERE r <= 1 UNION ALL SELECT doc_id, page, 'individual', NULL FROM pages_ WHERE doc_id NOT IN (SELECT doc_id FROM n)""")
def sample_groups(spark, sf_dir):
    return sampling.groups_sample(_pages(spark, sf_dir), 2, 2, 1)


@query(f"WITH {PAGES} SELECT doc_id, page FROM (SELECT *, {_picked()} AS r FROM pages_ WHERE page > 2) WHERE r <= 10")
def sample_unused(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return sampling.unused_pages(pages, pages.where("page <= 2"))


@query(f"WITH {PAGES}, n AS (SELECT doc_id, max(page) AS n FROM pages_ GROUP BY ALL) SELECT doc_id, page, CAST(CASE WHEN n < 5 OR page <= 3 THEN 1 ELSE 2 + (page - 4) // 2 END AS INTEGER) AS batch_no FROM pages_ JOIN n USING (doc_id)")
def page_batches(spark, sf_dir):
    return sampling.batches(_pages(spark, sf_dir), 3, 2, 5)


@query(f"""WITH {HEADED}, m AS ({SCAN}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pattern_name ORDER BY page, line_number, match_no) AS up, row_number() OVER (PARTITION BY doc_id, pattern_name ORDER BY page DESC, line_number DESC, match_no DESC) AS down FROM m),
p AS (SELECT *, CASE WHEN up <= 3 THEN 'front' WHEN down <= 3 THEN 'back' ELSE 'random' END AS part FROM r), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pattern_name, part ORDER BY md5('42:' || doc_id || ':' || page || ':' || line_number || ':' || match_no), page, line_number, match_no) AS k FROM p)
SELECT doc_id, pattern_name, page, line_number, part FROM q WHERE part <> 'random' OR k <= 3""")
def sample_matches(spark, sf_dir):
    return sampling.front_back_random(patterns.scan(headed(spark, sf_dir))).select("doc_id", "pattern_name", "page", "line_number", "part")


# Tokens and texts

TOKENS = LINES + ", tk AS (SELECT doc_id, page, CAST(sum(length(text) + 1) AS BIGINT) AS raw_length, CAST(sum(length(text) + 1) // 4 AS BIGINT) AS tokens, count(*) AS n_lines FROM lines GROUP BY ALL)"


@query(f"WITH {TOKENS} SELECT * FROM tk")
def page_tokens(spark, sf_dir):
    return tokens.page_tokens(lines_of(spark, sf_dir))


STATS = TOKENS + ", st AS (SELECT doc_id, count(*) AS n_pages, min(tokens) AS min_tokens, max(tokens) AS max_tokens, avg(tokens) AS mean_tokens, median(tokens) AS median_tokens, CASE WHEN count(*) > 1 THEN sqrt((sum(tokens * tokens)::DOUBLE * count(*) - sum(tokens)::DOUBLE * sum(tokens)::DOUBLE) / (count(*)::DOUBLE * (count(*)::DOUBLE - 1))) ELSE 0 END AS stdev_tokens, CAST(sum(tokens) AS BIGINT) AS sum_tokens FROM tk GROUP BY ALL)"


@query(f"WITH {STATS} SELECT * FROM st")
def token_statistics(spark, sf_dir):
    return tokens.token_statistics(tokens.page_tokens(lines_of(spark, sf_dir)))


@query(f"""WITH {STATS}, b AS (SELECT doc_id, CAST(floor(CASE WHEN max_tokens > 0 THEN 6000 / max_tokens ELSE 0 END) AS BIGINT) AS conservative, CAST(floor(CASE WHEN mean_tokens > 0 THEN 6000 / (mean_tokens + stdev_tokens) ELSE 0 END) AS BIGINT) AS recommended,
  CAST(floor(CASE WHEN mean_tokens > 0 THEN 6000 / mean_tokens ELSE 0 END) AS BIGINT) AS optimistic FROM st) SELECT *, least(recommended, 20) AS initial, least(recommended // 3, 8) AS incremental FROM b""")
def batch_recommendations(spark, sf_dir):
    return tokens.batch_recommendations(tokens.token_statistics(tokens.page_tokens(lines_of(spark, sf_dir))), 16_000)


@query("SELECT conv_id, turn, CAST(length(text) // 4 AS BIGINT) AS prompt_tokens, 1000::BIGINT AS answer_tokens, (length(text) // 4) / 1000 * 0.03 + 0.06 AS cost_usd FROM conversations")
def call_costs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    return tokens.call_costs(rows).drop("prompt")


@query("SELECT CAST(length(regexp_extract(x, '\\.(\\d+)$', 1)) AS INTEGER) AS decimals, count(*) AS n FROM (SELECT unnest(regexp_extract_all(props, '-?\\d+(?:\\.\\d+)?', 0)) AS x FROM events) GROUP BY ALL")
def numeric_literals(spark, sf_dir):
    return tokens.numeric_literals(table(spark, sf_dir, "events"), "props")


@query("SELECT f AS field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS f FROM events) GROUP BY ALL")
def field_usage(spark, sf_dir):
    return tokens.field_usage(table(spark, sf_dir, "events"), "props")


@query("SELECT f AS field, count(*) AS n, left(f, 1) AS short, CAST((length(f) - 1) * count(*) AS BIGINT) AS saved FROM (SELECT unnest(json_keys(props)) AS f FROM events) GROUP BY f")
def renaming_savings(spark, sf_dir):
    usage = tokens.field_usage(table(spark, sf_dir, "events"), "props")
    return tokens.renaming_savings(usage, usage.select("field", F.left("field", F.lit(1)).alias("short")))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM conversations")
def normalized_lines(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scalar.normalize_line(F.col("text")).alias("line"))


@query("""SELECT page_id, 'f' || page_id || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '_full' WHEN 2 THEN '' ELSE '_blocks' END AS base, CASE page_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS level FROM pages""")
def names_and_levels(spark, sf_dir):
    k = (F.col("page_id") % 4).cast("int")
    path = F.concat(F.lit("/a/b/f"), F.col("page_id").cast("string"), F.get(F.array(*[F.lit(s) for s in ("_lines.json", "_full_lines.json", "_words.json", "_blocks.json")]), k))
    word = F.get(F.array(*[F.lit(s) for s in ("HIGH", "med", "l", "perhaps")]), k)
    return table(spark, sf_dir, "pages").select("page_id", scalar.base_name(path).alias("base"), scalar.confidence(word).alias("level"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'be brief' END AS system, CASE WHEN turn % 2 = 0 THEN trim(text) ELSE text END AS user FROM (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM conversations)""")
def prompt_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", r"\s+", " "))
    filled = scalar.fill(F.lit("SYSTEM: {rule} USER: {text}"), {"rule": F.lit("be brief"), "text": F.col("text")})
    parts = scalar.prompt_parts(F.when(F.col("turn") % 2 == 0, filled).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", parts["system"].alias("system"), parts["user"].alias("user"))


@query(f"""WITH {HEADED}, b AS (SELECT doc_id, page, CAST(line_number % 3 AS INTEGER) AS block_no, text FROM headed), h AS (SELECT * FROM b WHERE contains(text, '...') AND regexp_matches(text, '(^|\\s)\\d+\\s*$'))
SELECT doc_id, page, block_no, count(*) AS entries FROM h GROUP BY ROLLUP (doc_id, page, block_no) HAVING doc_id IS NOT NULL""")
def contents_entries(spark, sf_dir):
    rows = headed(spark, sf_dir).select("doc_id", "page", (F.col("line_number") % 3).cast("int").alias("block_no"), F.array("text").alias("text_lines"))
    return answers.toc_entries(rows)


# Answers of models


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded-style answers of four shapes, made of the order table."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).distinct()
    head = F.to_json(F.struct(
        F.array(F.struct(
            (F.col("k") % 40).cast("int").alias("page_index"), F.struct((F.col("k") % 2 == 0).alias("detected"), F.lit("h").alias("confidence")).alias("header"),
            F.struct(F.array(F.struct(F.concat(F.lit("S"), F.col("k").cast("string")).alias("text"), F.lit(2).alias("hierarchy_level"))).alias("section_headings"), F.array(F.struct(F.lit("F1").alias("text"))).alias("figure_titles")).alias("document_elements"),
        )).alias("per_page_analysis"), F.struct((F.col("k") % 100).cast("string").alias("main_content_starts_after_y"), F.lit("n/a").alias("main_content_ends_before_y"), F.lit("med").alias("confidence")).alias("content_area_boundaries"),
    ))
    kind = (F.floor(F.col("k") / 3) % 4).cast("int")
    shapes = F.array(F.concat(F.lit("Here:\n```json\n"), head, F.lit("\n```\nDone.")), F.concat(F.lit("Sure "), head, F.lit(" ok")), F.lit("no answer"), F.lit('{"other": 1}'))
    return o.select(F.col("k").alias("answer_id"), F.get(shapes, kind).alias("content"))


ANSWERS = "a AS (SELECT DISTINCT o_orderkey AS k, o_orderkey // 3 % 4 AS s FROM orders)"


@query(f"WITH {ANSWERS} SELECT k AS answer_id, CASE s WHEN 2 THEN 'no JSON object' WHEN 3 THEN 'per_page_analysis is missing' ELSE '' END AS problems FROM a")
def answer_problems(spark, sf_dir):
    return answers.parsed(answered(spark, sf_dir)).select("answer_id", F.array_join("problems", "; ").alias("problems"))


@query(f"WITH {ANSWERS} SELECT k AS answer_id, CAST(k % 40 AS INTEGER) AS page_index, t.element_type, t.text, t.lvl AS hierarchy_level FROM a, LATERAL (VALUES ('section_headings', 'S' || k, 2), ('figure_titles', 'F1', NULL)) t(element_type, text, lvl) WHERE s < 2")
def answer_elements(spark, sf_dir):
    found = answers.elements(answers.pages(answers.parsed(answered(spark, sf_dir))))
    return found.select("answer_id", "page_index", "element_type", "text", "hierarchy_level")


@query(f"WITH {ANSWERS} SELECT k AS answer_id, CASE WHEN s < 2 THEN CAST(k % 100 AS DOUBLE) ELSE 0 END AS start_y, 792.0::DOUBLE AS end_y, CASE WHEN s < 2 THEN 'Medium' ELSE 'Low' END AS confidence FROM a")
def answer_content_area(spark, sf_dir):
    return answers.content_area(answers.parsed(answered(spark, sf_dir)))


@query(f"""WITH {ANSWERS}, e AS (SELECT 'section_headings' AS t FROM a WHERE s < 2 UNION ALL SELECT 'figure_titles' FROM a WHERE s < 2) SELECT coalesce(t, 'all') AS content_type, count(*) AS n FROM e GROUP BY ROLLUP (t)""")
def answer_totals(spark, sf_dir):
    found = answers.elements(answers.pages(answers.parsed(answered(spark, sf_dir))))
    return results.content_totals({k: found.where(F.col("element_type") == k) for k in answers.ELEMENT_KINDS})


@query("SELECT event_id, k.f AS kind, 0 AS n FROM events, LATERAL (SELECT unnest(json_keys(props)) AS f) k UNION ALL SELECT event_id, 'list', CAST(event_id % 4 AS INTEGER) FROM events")
def finding_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props", F.to_json(F.struct(F.slice(F.array(*[F.lit(i) for i in (1, 2, 3)]), F.lit(1), (F.col("event_id") % 4).cast("int")).alias("list"))).alias("more"))
    both = e.select("event_id", F.col("props").alias("json")).unionByName(e.select("event_id", F.col("more").alias("json")))
    return answers.finding_counts(both, "event_id")


# Runs


def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.alias("run_id"), (k % 7 != 0).alias("success"), (k * 131 % 997 / 4.0 + 1.0).alias("seconds"), (k % 300).cast("int").alias("kilobytes"), (k % 90).alias("tokens"),
        (F.floor(k / 50)).cast("int").alias("group_no"), (k % 50 + 1).cast("int").alias("objectives"), F.when(k % 3 > 0, k % 11).alias("prompt_tokens"), (k % 13).alias("completion_tokens"),
    )


RUNS = "r AS (SELECT event_id AS run_id, event_id % 7 <> 0 AS success, event_id * 131 % 997 / 4.0::DOUBLE + 1 AS seconds, event_id % 300 AS kilobytes, event_id % 90 AS tokens, CAST(event_id // 50 AS INTEGER) AS group_no, CAST(event_id % 50 + 1 AS INTEGER) AS objectives, CASE WHEN event_id % 3 > 0 THEN event_id % 11 END AS prompt_tokens, event_id % 13 AS completion_tokens FROM events)"


@query(f"WITH {RUNS} SELECT count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, avg(seconds) FILTER (success) AS mean_seconds, CAST(sum(tokens) AS BIGINT) AS tokens FROM r")
def run_summary(spark, sf_dir):
    return results.summary(runs_of(spark, sf_dir))


@query(f"WITH {RUNS} SELECT CASE WHEN kilobytes < 50 THEN 'small' WHEN kilobytes < 150 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n, avg(seconds) AS mean_seconds FROM r WHERE success GROUP BY ALL")
def runs_by_size(spark, sf_dir):
    return results.by_size(runs_of(spark, sf_dir))


@query(f"WITH {RUNS} (SELECT 'fastest' AS kind, run_id, seconds FROM r WHERE success ORDER BY seconds, run_id LIMIT 5) UNION ALL (SELECT 'slowest', run_id, seconds FROM r WHERE success ORDER BY seconds DESC, run_id DESC LIMIT 3)")
def run_extremes(spark, sf_dir):
    return results.extremes(runs_of(spark, sf_dir))


@query(f"WITH {RUNS} SELECT max(seconds) / min(seconds) AS slowest_to_fastest FROM r WHERE success")
def run_spread(spark, sf_dir):
    return results.spread(runs_of(spark, sf_dir))


@query(f"WITH {RUNS} SELECT group_no, objectives, first_value(seconds) OVER (PARTITION BY group_no ORDER BY objectives) / seconds * objectives AS efficiency FROM r")
def run_scaling(spark, sf_dir):
    return results.scaling(runs_of(spark, sf_dir))


@query(f"WITH {RUNS}, q AS (SELECT group_no, count(*) AS n, count(*) FILTER (NOT (run_id % 700 > 0)) AS failed FROM r WHERE run_id > 0 GROUP BY ALL) SELECT group_no, n, failed FROM (SELECT *, coalesce(sum(failed) OVER (ORDER BY group_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM q) WHERE b = 0")
def runs_until_failure(spark, sf_dir):
    return results.until_failure(runs_of(spark, sf_dir).where("run_id > 0").withColumn("success", F.col("run_id") % 700 > 0))


@query(f"WITH {RUNS} SELECT CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(coalesce(prompt_tokens, 0) + completion_tokens) AS BIGINT) AS total_tokens, count(*) AS calls FROM r")
def run_tokens(spark, sf_dir):
    return results.token_totals(runs_of(spark, sf_dir))


@query("""WITH e AS (SELECT n_nationkey AS page, 'toc' AS kind, n_nationkey % 3 AS expected FROM nation), f AS (SELECT n_nationkey AS page, 'toc' AS kind, n_nationkey % 2 AS found FROM nation WHERE n_nationkey % 5 > 0)
SELECT kind, count(*) FILTER (coalesce(expected, 0) > 0 AND coalesce(found, 0) > 0) AS true_positive, count(*) FILTER (coalesce(expected, 0) > 0 AND coalesce(found, 0) = 0) AS false_negative, count(*) FILTER (coalesce(expected, 0) = 0 AND coalesce(found, 0) > 0) AS false_positive, count(*) FILTER (coalesce(expected, 0) = 0 AND coalesce(found, 0) = 0) AS true_negative FROM e FULL JOIN f USING (page, kind) GROUP BY kind""")
def confusion_table(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = [F.col("n_nationkey").alias("page"), F.lit("toc").alias("kind")]
    return results.confusion_table(results.confusion(n.select(*key, (F.col("n_nationkey") % 3).alias("expected")), n.where("n_nationkey % 5 > 0").select(*key, (F.col("n_nationkey") % 2).alias("found"))))


@query("SELECT n_nationkey AS test_id, n_nationkey % 2 = 0 AS expected_empty, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 3 = 0 ELSE n_nationkey % 3 > 0 END AS as_expected FROM nation")
def expected_empty(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return results.expected_empty(n.select(F.col("n_nationkey").alias("test_id"), F.when(F.col("n_nationkey") % 2 == 0, "Page without contents").otherwise("Page of contents").alias("description"), (F.col("n_nationkey") % 3).alias("found")))


@query("SELECT n_nationkey AS page, n_nationkey % 4 AS found, n_nationkey % 5 AS expected, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey % 4 * 100.0::DOUBLE / (n_nationkey % 5) ELSE 0 END AS accuracy FROM nation")
def accuracy(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "page")
    return results.accuracy(n.select("page", (F.col("page") % 4).alias("found")), n.select("page", (F.col("page") % 5).alias("expected")), "page")


@query("SELECT 30.2::DOUBLE / 101.9 AS ratio, false AS enough")
def multi_to_single(spark, sf_dir):
    return results.multi_to_single(spark.createDataFrame([("single", 101.9), ("multi", 30.2)], "kind string, accuracy double"))


@query("SELECT n_name AS metric, n_regionkey AS left_value, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey % 5 END AS right_value, n_regionkey IS NOT DISTINCT FROM CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey % 5 END AS same FROM nation")
def same_metrics(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    left = n.select(F.col("n_name").alias("metric"), F.col("n_regionkey").alias("value"))
    return results.same_metrics(left, n.where("n_nationkey % 4 > 0").select(F.col("n_name").alias("metric"), (F.col("n_nationkey") % 5).alias("value")))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE n_name END AS v FROM nation UNION ALL SELECT 100 + r_regionkey, 'new' FROM region")
def overwritten_keys(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    more = n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("k"), F.lit("new").alias("v")).unionByName(r.select((100 + F.col("r_regionkey")).alias("k"), F.lit("new").alias("v")))
    return results.overwritten(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), more, "k")


@query("SELECT r_name AS template, n_name AS page FROM region, nation")
def run_matrix(spark, sf_dir):
    return results.matrix(table(spark, sf_dir, "region").select(F.col("r_name").alias("template")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("page")))


# Workflow

STATES = [("start", ["document"], False), ("scan", [], False), ("sample", [], False), ("ask", [], False), ("done", [], True), ("stop", [], True)]
EDGES = [("start", "ok", "scan"), ("scan", "few", "ask"), ("scan", "many", "sample"), ("sample", "ok", "ask"), ("ask", "again", "scan"), ("ask", "ok", "done"), ("ask", "error", "stop")]
GRAPH = "s(state) AS (VALUES " + ", ".join(f"('{s}')" for s, *_ in STATES) + "), e(src, key, dst) AS (VALUES " + ", ".join(str(e) for e in EDGES) + ")"


def graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(STATES, "state string, required_fields array<string>, is_terminal boolean"), spark.createDataFrame(EDGES, "src string, key string, dst string")


@query(f"""WITH RECURSIVE {GRAPH}, w(path, at_, open) AS (SELECT [state], state, true FROM s WHERE state NOT IN (SELECT dst FROM e) UNION ALL
  SELECT list_append(path, CASE WHEN list_contains(path, dst) THEN dst || '*' ELSE dst END), dst, NOT list_contains(path, dst) FROM w JOIN (SELECT DISTINCT src, dst FROM e) ON at_ = src WHERE open)
SELECT array_to_string(path, ' > ') AS path FROM w WHERE NOT open OR at_ NOT IN (SELECT src FROM e)""")
def workflow_paths(spark, sf_dir):
    return workflow.simple_paths(*graph(spark))


@query(f"WITH {GRAPH} SELECT 'entry' AS kind, state FROM s WHERE state NOT IN (SELECT dst FROM e) UNION ALL SELECT 'end', state FROM s WHERE state NOT IN (SELECT src FROM e) UNION ALL SELECT 'unknown target', 'lost' UNION ALL SELECT 'leads to itself', 'scan'")
def workflow_checks(spark, sf_dir):
    states, edges = graph(spark)
    kinds = workflow.entry_states(states, edges).select(F.lit("entry").alias("kind"), "state").unionByName(workflow.terminal_states(states, edges).select(F.lit("end").alias("kind"), "state"))
    broken = edges.unionByName(spark.createDataFrame([("ask", "x", "lost"), ("scan", "y", "scan")], edges.schema))
    return kinds.unionByName(workflow.problems(states, broken).select(F.col("problem").alias("kind"), "state"))


@query(f"WITH {GRAPH} SELECT '\"' || src || '\" -> \"' || dst || '\" [label=\"' || key || '\"];' AS line FROM e")
def workflow_dot(spark, sf_dir):
    return workflow.dot(graph(spark)[1])


@query(f"WITH {GRAPH} SELECT state, count(dst) AS outcomes FROM s LEFT JOIN e ON src = state GROUP BY state")
def workflow_json(spark, sf_dir):
    found = workflow.as_json(*graph(spark))
    names = F.json_object_keys(F.get_json_object("json", "$.outcomes"))
    return found.select("state", F.coalesce(F.size(names), F.lit(0)).cast("bigint").alias("outcomes"))


@query(f"""WITH {HIST} (SELECT 'fonts' AS section, predominant_font || ': ' || count(*) AS line FROM lines GROUP BY predominant_font ORDER BY count(*) DESC, predominant_font LIMIT 10)
UNION ALL (SELECT 'sizes', printf('%.1f pt', predominant_size) || ': ' || count(*) FROM lines GROUP BY predominant_size ORDER BY count(*) DESC, printf('%.1f pt', predominant_size) LIMIT 10)
UNION ALL (SELECT 'gaps', printf('%.1f pt', gap) || ': ' || sum(cnt)::BIGINT FROM hist GROUP BY gap ORDER BY sum(cnt) DESC, printf('%.1f pt', gap) LIMIT 10)""")
def report_lines(spark, sf_dir):
    return report.report_lines(gapped(spark, sf_dir))


@query()
def recorded_answers(spark, sf_dir):
    """Prompts of every document's page sample, answered from recordings."""
    asked = analysis.sampled_prompts(gapped(spark, sf_dir))

    class Echo:
        def complete(self, prompt: str) -> provider.Answer:
            return provider.Answer('{"per_page_analysis": []}', len(prompt) // 4, 6, "echo")

    return provider.completed(asked, Echo()).select("doc_id", "prompt_tokens", "completion_tokens", "model")




# Further sources and reports


@query("""SELECT n_regionkey AS doc_id, CAST(n_nationkey AS INTEGER) AS page, i AS word_no, n_name || i AS text, n_nationkey * 1.5::DOUBLE AS x0, i * 2.0::DOUBLE AS top, 9.5::DOUBLE AS size, 'F' AS fontname FROM nation, (VALUES (0), (1)) v(i)""")
def word_metadata(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    one = lambda i: F.struct(F.concat("n_name", F.lit(str(i))).alias("text"), (F.col("n_nationkey") * 1.5).alias("x0"), F.lit(i * 2.0).alias("top"), F.lit(9.5).alias("size"), F.lit("F").alias("fontname"))
    doc = F.to_json(F.create_map(F.concat(F.lit("Page "), F.col("n_nationkey").cast("string")), F.array(one(0), one(1))))
    return records.word_metadata(n.select(F.col("n_regionkey").alias("doc_id"), doc.alias("json")))


@query(f"WITH {WORDS} SELECT page, word_seq, CAST(floor(top / 10) AS INTEGER) AS line_number FROM w")
def banded_lines(spark, sf_dir):
    return records.banded(words_of(spark, sf_dir)).select("page", "word_seq", "line_number")


@query("SELECT n_nationkey AS test_id, n_nationkey * 2 AS a, 'v' || n_nationkey AS b FROM nation")
def prompt_results(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    body = F.to_json(F.struct((F.col("n_nationkey") * 2).alias("a"), F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("b")))
    text = F.to_json(F.struct(body.alias("response_content")))
    doc = F.when(F.col("n_nationkey") % 2 == 0, text).otherwise(F.concat(F.lit('{"response_content":'), body, F.lit("}")))
    found = records.prompt_results(n.select(F.col("n_nationkey").alias("test_id"), doc.alias("json")), "struct<a: bigint, b: string>")
    return found.select("test_id", "response.a", "response.b")


@query(f"WITH {PAGES} SELECT doc_id, page FROM pages_ WHERE page = doc_id % 3 + 1")
def chosen_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return records.chosen_pages(pages, pages.where("page = doc_id % 3 + 1"))


@query(f"WITH {PAGES}, d AS (SELECT DISTINCT doc_id, doc_id % 3 + 1 AS page FROM pages_) SELECT doc_id, CAST(page AS INTEGER) AS page FROM d WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM pages_)")
def missing_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return records.missing_pages(pages, pages.select("doc_id", (F.col("doc_id") % 3 + 1).cast("int").alias("page")))


@query(f"""WITH RECURSIVE {WORDS}, o AS (SELECT page, top, row_number() OVER (PARTITION BY page ORDER BY top) AS i FROM (SELECT DISTINCT page, top FROM w)),
fold(page, i, anchor, n) AS (SELECT page, i, top, 1 FROM o WHERE i = 1 UNION ALL SELECT o.page, o.i, CASE WHEN abs(o.top - anchor) > 2 THEN o.top ELSE anchor END, n + CASE WHEN abs(o.top - anchor) > 2 THEN 1 ELSE 0 END FROM fold f JOIN o ON o.page = f.page AND o.i = f.i + 1)
SELECT doc_id, w.page, CAST(n AS INTEGER) AS line_number, string_agg(text, ' ' ORDER BY x0, word_seq) AS text, min(x0) AS x0, min(w.top) AS top, arg_min(fontname, {{'a': x0, 'b': word_seq}}) AS predominant_font, arg_min(size, {{'a': x0, 'b': word_seq}}) AS predominant_size FROM w JOIN o ON w.page = o.page AND w.top = o.top JOIN fold f ON f.page = o.page AND f.i = o.i GROUP BY doc_id, w.page, n""")
def spaced_lines(spark, sf_dir):
    return words.spaced_lines(words_of(spark, sf_dir))


@query(f"""WITH RECURSIVE {SEGMENTS}, d AS (SELECT DISTINCT doc_id, page, line_number, font, rounded_size FROM seg), k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page, line_number) AS kinds FROM d)
SELECT font, rounded_size AS size, count(*) AS lines, count(*) FILTER (kinds > 1) AS partial_lines FROM k GROUP BY ALL""")
def fonts_by_lines(spark, sf_dir):
    return checks.fonts_by_lines(words.segments(word_lines(spark, sf_dir)))


@query(f"WITH {HEADED} SELECT doc_id, page, line_number, regexp_matches(text, '(?i)contents') AS is_header, regexp_matches(text, '\\d+\\.\\d+') AS has_section, regexp_matches(text, '\\.\\s*\\d+\\s*$') AS has_page_number, regexp_matches(text, '\\d+\\.\\d+\\.\\d+') AS has_three_levels FROM headed")
def contents_flags(spark, sf_dir):
    return checks.contents_flags(headed(spark, sf_dir))


@query("SELECT n_regionkey AS doc_id, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey END AS page, concat_ws(',', CASE WHEN n_nationkey % 5 = 0 THEN 'page' END, CASE WHEN n_nationkey % 3 = 0 THEN 'blocks' END, CASE WHEN n_nationkey % 7 = 0 THEN 'page_width' END) AS problems FROM nation")
def structure_problems(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.when(k % 5 > 0, k).alias("page"), (k % 3).alias("n_blocks"), (k % 7 * 100.0).alias("page_width"), F.lit(792.0).alias("page_height"))
    return checks.structure_problems(rows)


@query("SELECT conv_id, turn, CAST(length(text) // 4 AS BIGINT) AS by_four, CAST(floor(length(text) / 3.5::DOUBLE) AS BIGINT) AS by_three_and_half, CAST(length(text) // 3 AS BIGINT) AS by_three FROM conversations")
def token_estimates(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    return checks.estimates(rows, "id").select("id.*", "by_four", "by_three_and_half", "by_three")


@query(f"WITH {HEADED}, m AS ({SCAN}), {CATALOGUE} SELECT m.doc_id, m.line_number, pattern_name, pattern_type, hierarchy_level FROM m JOIN cat ON name = pattern_name WHERE pattern_type LIKE 'toc%' OR pattern_name = 'figure_caption'")
def matches_by_type(spark, sf_dir):
    found = patterns.by_type(patterns.scan(headed(spark, sf_dir)), patterns.catalogue(spark))
    return found.where("pattern_type LIKE 'toc%' OR pattern_name = 'figure_caption'").select("doc_id", "line_number", "pattern_name", "pattern_type", "hierarchy_level")


@query(f"WITH {HEADED}, m AS ({SCAN}), {CATALOGUE}, s AS (SELECT name, pattern_type, count(m.match) AS k FROM cat LEFT JOIN m ON name = pattern_name GROUP BY ALL) SELECT pattern_type, count(*) FILTER (k > 0) AS patterns_found, CAST(sum(k) AS BIGINT) AS matches FROM s GROUP BY ALL")
def state_results(spark, sf_dir):
    return checks.state_results(patterns.statistics(patterns.scan(headed(spark, sf_dir)), patterns.catalogue(spark)))


@query(f"WITH {LINES}, k AS (SELECT split_part(predominant_font, '-', 1) || '|' || CAST(predominant_size AS VARCHAR) || '|' || CASE WHEN predominant_font LIKE '%BoldItalic%' THEN 'Bold+Italic' WHEN predominant_font LIKE '%Bold%' THEN 'Bold' ELSE 'Regular' END AS font_key FROM lines) SELECT font_key, count(*) AS total FROM k GROUP BY ALL ORDER BY total DESC, font_key LIMIT 10")
def top_fonts(spark, sf_dir):
    return checks.top_fonts(patterns.font_usage(lines_of(spark, sf_dir)))


@query(f"WITH {GAPS} SELECT doc_id, page, line_number, printf('%8.2f  ', top) || text || CASE WHEN gap_before >= 5 THEN printf('  [%.2f pt]', gap_before) ELSE '' END AS line FROM g")
def text_view(spark, sf_dir):
    return checks.text_view(gapped(spark, sf_dir))


@query(f"""WITH {BLOCKS}, o AS (SELECT doc_id, CASE WHEN lag(bottom) {BW} IS NULL THEN top ELSE top - lag(bottom) {BW} END AS gap FROM blk UNION ALL SELECT doc_id, 792 - max(bottom) FROM blk GROUP BY doc_id, page)
SELECT doc_id, round_even(gap / 0.5, 0) * 0.5 AS spacing, count(*) AS n FROM o WHERE gap > 0 GROUP BY ALL""")
def block_spacing_occurrences(spark, sf_dir):
    lines = gapped(spark, sf_dir)
    found = blocks.blocks(blocks.numbered_lines(lines, rules_of(lines)))
    return layout.spacing_occurrences(found.select("doc_id", "page", F.col("block_no").alias("line_number"), "top", "bottom", F.lit(792.0).alias("page_height")))


@query(f"WITH {BLOCKS} SELECT doc_id, page, count(*) AS n_blocks, CAST(sum(n_lines) AS BIGINT) AS n_lines FROM blk GROUP BY ALL")
def pages_json(spark, sf_dir):
    lines = gapped(spark, sf_dir)
    nested = blocks.pages_json(blocks.blocks(blocks.numbered_lines(lines, rules_of(lines))))
    back = nested.select("doc_id", "page", F.from_json("blocks", "array<struct<block_no: int, n_lines: bigint>>").alias("b"))
    return back.select("doc_id", "page", F.size("b").cast("bigint").alias("n_blocks"), F.aggregate("b", F.lit(0).cast("bigint"), lambda s, x: s + x["n_lines"]).alias("n_lines"))


@query(f"WITH {ANSWERS} SELECT k AS answer_id, CASE WHEN s < 2 THEN 'i' || k || '|why' END AS insights FROM a WHERE s < 2")
def answer_insights(spark, sf_dir):
    k = F.col("answer_id")
    rows = answered(spark, sf_dir).select("answer_id").where(F.floor(k / 3) % 4 < 2)
    body = F.to_json(F.struct(F.array().cast("array<string>").alias("per_page_analysis"), F.array(F.concat(F.lit("i"), k.cast("string"))).alias("insights"), F.struct(F.lit("why").alias("reasoning")).alias("header_pattern")))
    return answers.insights(answers.parsed(rows.select("answer_id", body.alias("content")))).select("answer_id", F.array_join("insights", "|").alias("insights"))


@query(f"WITH {ANSWERS} SELECT k AS answer_id, 'S' || k AS text FROM a WHERE s < 2 AND k % 40 = 7")
def elements_on_page(spark, sf_dir):
    found = answers.elements(answers.pages(answers.parsed(answered(spark, sf_dir))))
    return found.where("page_index = 7 AND element_type = 'section_headings'").select("answer_id", "text")


@query(f"WITH {PAGES}, b AS (SELECT doc_id, page, 'a' || page AS content, 1 AS batch_no FROM pages_ WHERE page <= 2 UNION ALL SELECT doc_id, page, 'b' || page, 2 FROM pages_ WHERE page >= 2) SELECT doc_id, page, arg_min(content, batch_no) AS content, min(batch_no) AS batch_no FROM b GROUP BY ALL")
def merged_batches(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    part = lambda d, c, n: d.select("doc_id", "page", F.concat(F.lit(c), F.col("page").cast("string")).alias("content"), F.lit(n).alias("batch_no"))
    return checks.merged_batches(part(pages.where("page <= 2"), "a", 1).unionByName(part(pages.where("page >= 2"), "b", 2)))


@query("SELECT n_nationkey AS doc_id, p AS page FROM nation, (VALUES (1), (2), (5), (6), (9)) v(p)")
def used_pages(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"))
    both = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(5), F.lit(6)))
    return checks.used_pages(n.select("doc_id", both.alias("groups"), F.array(F.lit(2), F.lit(9)).alias("singles")))


@query("""WITH s AS (SELECT n_nationkey AS number, n_name AS heading, n_regionkey AS heading_page FROM nation WHERE n_nationkey % 2 = 0), c AS (SELECT n_nationkey AS number, n_name AS entry, n_regionkey + 1 AS entry_page FROM nation WHERE n_nationkey % 3 = 0) SELECT * FROM s FULL JOIN c USING (number)""")
def sections_in_contents(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    row = [F.col("n_nationkey").alias("number"), F.col("n_name").alias("title")]
    return checks.sections_in_contents(n.where("n_nationkey % 2 = 0").select(*row, F.col("n_regionkey").alias("page")), n.where("n_nationkey % 3 = 0").select(*row, (F.col("n_regionkey") + 1).alias("target")))


@query("SELECT n_regionkey AS page, n_nationkey AS test_id, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS response, CASE WHEN n_regionkey < 3 THEN r_name ELSE 'Unknown page' END AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def results_with_labels(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tests = n.select(F.col("n_nationkey").alias("test_id"), F.col("n_regionkey").alias("page"))
    responses = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("test_id"), F.col("n_name").alias("response"))
    return checks.with_responses(tests, responses, r.where("r_regionkey < 3").select(F.col("r_regionkey").alias("page"), F.col("r_name").alias("label")))


@query("SELECT n_nationkey AS k, trim(x) AS item FROM nation, LATERAL (SELECT unnest(['red', n_name, 'b c']) AS x) t")
def parsed_lists(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("k"), F.explode(checks.parsed_list(F.concat(F.lit("red ,"), "n_name", F.lit(", b c ")))).alias("item"))


@query()
def rounding_savings(spark, sf_dir):
    """Decimal rounding of a binary value differs between engines; see the tests."""
    return tokens.rounding_savings(table(spark, sf_dir, "events").select("value"), "value", 1)


@query()
def rounded_numbers(spark, sf_dir):
    return checks.rounded(checks.renamed(table(spark, sf_dir, "events").select("event_id", "value"), {"value": "v"}), 1)
