"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are parted by their number of shingles into classes that double. An
item's signature is its bottom-k MinHash: the k smallest shingle hashes, k set
by the upper size of its class. A text that contains the share ``threshold``
of an item's n shingles misses at most ``n - ceil(threshold * n)`` of them, so
of the k it holds at least k less that many: an item and a text with fewer hits
need no look, and none that counts is lost. Candidates are verified by exact
containment of the shingles themselves, as strings, over the whole text.

Only built-in functions run. Texts are lower-cased; words are runs of letters
and digits; a shingle is ``width`` words, or all words of an item that has
fewer, and then texts are cut into shingles of that length as well. Items and
texts without words match nothing. Nulls count as empty. Equal items with
equal ids count once. A text is told by its key and its SHA-256, so repeated
rows give one result and null keys are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import quoted, written

WIDTH = 5
THRESHOLD = 0.8
SKETCH_SHARE = 0.4
#: Rows of (hash, item) that are broadcast at most, about 40 bytes each;
#: larger benchmarks join by shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(tokens: Column, width: int) -> Column:
    """Distinct hashes of all runs of ``width`` words."""
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - width),
        lambda i: F.xxhash64(F.lit(width), *[F.get(tokens, i + k) for k in range(width)]),
    )
    return F.when(F.size(tokens) >= width, F.array_distinct(hashed)).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(tokens: Column, width: int) -> Column:
    """All distinct runs of ``width`` words, each in one string."""
    joined = F.transform(F.sequence(F.lit(0), F.size(tokens) - width), lambda i: F.array_join(F.slice(tokens, i + 1, width), " "))
    return F.when(F.size(tokens) >= width, F.array_distinct(joined)).otherwise(F.array().cast("array<string>"))


def text_hash(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def item_table(items: DataFrame, key: str, text: str, width: int, threshold: float) -> DataFrame:
    """One row per item that has words: its shingles, signature and least hits."""
    named = items.select(F.col(quoted(key)).alias("item_id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text")).distinct()
    cut = named.select("item_id", F.monotonically_increasing_id().alias("item_key"), words(F.col("text")).alias("w")).where(F.size("w") > 0)

    def own(cuts, kind: str) -> Column:
        chosen = F.lit(None).cast(kind)
        for n in range(1, width):
            chosen = F.when(F.size("w") == n, cuts(F.col("w"), n)).otherwise(chosen)
        return F.when(F.size("w") >= width, cuts(F.col("w"), width)).otherwise(chosen)

    sized = cut.select(
        "item_id", "item_key", F.least(F.size("w"), F.lit(width)).alias("width"), own(shingles, "array<bigint>").alias("shingles"), own(shingle_texts, "array<string>").alias("texts")
    ).withColumn("n", F.size("texts"))
    # class c holds sizes from 2^c to 2^(c+1) - 1
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    misses = F.col("n") - F.ceil(F.col("n") * threshold)
    share = max(SKETCH_SHARE, 1 - threshold)
    return (
        sized.withColumn("k", F.least(F.col("n"), (F.floor(upper * share) + 1).cast("int")))
        .withColumn("least_hits", F.greatest(F.lit(1), F.col("k") - misses).cast("int"))
        .withColumn("signature", F.slice(F.array_sort("shingles"), 1, F.col("k")))
    )


def _small(rows: DataFrame, count: int) -> DataFrame:
    return F.broadcast(rows) if count <= BROADCAST_ROWS else rows


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_key, text_hash, item_id, matched, item_shingles): every text and
    item whose share of contained shingles, matched / item_shingles, is at
    least ``threshold``."""
    if not 0 < threshold <= 1 or width < 1:
        raise ValueError("threshold must be in (0, 1] and width at least 1")
    table, _ = written(item_table(items, item_key, item_text, width, threshold), "benchmark-items")
    bound = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.collect_set("width").alias("widths")).first()
    rows, widths = bound["n"], sorted(bound["widths"])
    body = docs.select(F.col(quoted(key)).alias("doc_key"), text_hash(F.col(quoted(text))).alias("text_hash"), words(F.col(quoted(text))).alias("w"))

    def spread(cuts, name: str, some: DataFrame) -> DataFrame:
        parts = [cuts(F.col("w"), n) for n in widths] or [F.array().cast("array<bigint>")]
        return some.select("doc_key", "text_hash", F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias(name))

    signature = _small(table.select("item_key", "k", "least_hits", F.explode("signature").alias("h")), rows)
    candidates, _ = written(
        spread(shingles, "h", body).join(signature, "h").groupBy("doc_key", "text_hash", "item_key")
        .agg(F.count(F.lit(1)).alias("hits"), F.first("least_hits").alias("least_hits"))
        .where("hits >= least_hits").select("doc_key", "text_hash", "item_key"),
        "contamination-candidates",
    )
    held = candidates.select(F.col("doc_key").alias("k1"), F.col("text_hash").alias("k2")).distinct()
    again = body.join(held, body["doc_key"].eqNullSafe(held["k1"]) & (body["text_hash"] == held["k2"]), "left_semi")
    every = _small(table.select("item_key", "item_id", "n", F.explode("texts").alias("s")), rows)
    matched = (
        spread(shingle_texts, "s", again).join(every, "s").groupBy("doc_key", "text_hash", "item_key", "item_id", "n")
        .agg(F.count_distinct("s").alias("matched")).where(F.col("matched") >= F.ceil(F.col("n") * threshold))
    )
    proven = candidates.select(F.col("doc_key").alias("k1"), F.col("text_hash").alias("k2"), F.col("item_key").alias("k3"))
    same = matched["doc_key"].eqNullSafe(proven["k1"]) & (matched["text_hash"] == proven["k2"]) & (matched["item_key"] == proven["k3"])
    return matched.join(proven, same, "left_semi").select(
        "doc_key", "text_hash", "item_id", F.col("matched").cast("int").alias("matched"), F.col("n").alias("item_shingles")
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns kept."""
    found, _ = written(contaminated(docs, items, key, text, **how).select(F.col("doc_key").alias("k1"), F.col("text_hash").alias("k2")).distinct(), "contaminated")
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    told = docs.select(row.alias("row"), F.col(quoted(key)).alias("k"), text_hash(F.col(quoted(text))).alias("h"))
    return told.join(found, F.col("k").eqNullSafe(F.col("k1")) & (F.col("h") == F.col("k2")), "left_anti").select("row.*")


def oracle(width: int = WIDTH, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of the same pairs by plain containment of all shingles."""
    cut = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    runs = "list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' ')))"
    return f"""
WITH i AS (SELECT DISTINCT item_id, text FROM benchmark),
iw AS (SELECT item_id, text, {cut} AS w FROM i),
it AS (SELECT item_id, text, least(len(w), {width}) AS width, CASE WHEN len(w) >= {width} THEN {runs.format(n=width)} ELSE [array_to_string(w, ' ')] END AS s FROM iw WHERE len(w) > 0),
ix AS (SELECT item_id, text, width, len(s) AS n, unnest(s) AS s FROM it),
dw AS (SELECT DISTINCT doc_id, text, {cut} AS w FROM documents),
dx AS (SELECT doc_id, text, k.width, unnest(CASE WHEN len(w) >= k.width THEN list_distinct(list_transform(range(1, len(w) - k.width + 2), lambda i: array_to_string(list_slice(w, i, i + k.width - 1), ' '))) ELSE [] END) AS s
       FROM dw, (SELECT DISTINCT width FROM it) k)
SELECT dx.doc_id, ix.item_id, CAST(count(*) AS INTEGER) AS matched, CAST(ix.n AS INTEGER) AS item_shingles
FROM dx JOIN ix ON dx.s = ix.s AND dx.width = ix.width
GROUP BY dx.doc_id, dx.text, ix.item_id, ix.text, ix.n
HAVING count(*) >= ceil(ix.n * {threshold})
"""


