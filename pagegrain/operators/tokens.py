"""Token, cost and size reports over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.functions.scalar import call_cost, token_estimate


def page_tokens(pages: DataFrame) -> DataFrame:
    """(doc_id, page, raw_length, tokens, n_lines) of a page's lines as one text."""
    whole = F.sum(F.length("text") + 1)
    return pages.groupBy("doc_id", "page").agg(whole.alias("raw_length"), F.floor(whole / 4).cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("n_lines"))


def token_statistics(stats: DataFrame) -> DataFrame:
    """Least, most, mean, median, deviation and sum of a document's pages."""
    x = F.col("tokens").cast("double")
    n, one, two = F.count(F.lit(1)).cast("double"), F.sum(x), F.sum(x * x)
    # from sums of whole numbers, so that no order of addition shows
    spread = F.when(n > 1, F.sqrt((two * n - one * one) / (n * (n - 1)))).otherwise(F.lit(0.0))
    return stats.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.min("tokens").alias("min_tokens"), F.max("tokens").alias("max_tokens"), F.avg("tokens").alias("mean_tokens"),
        F.median("tokens").alias("median_tokens"), spread.alias("stdev_tokens"), F.sum("tokens").alias("sum_tokens"),
    )


def batch_recommendations(statistics: DataFrame, limit: int, overhead: int = 10_000, initial: int = 20, further: int = 8) -> DataFrame:
    """Pages that fit a batch by the largest page, by mean plus deviation and by
    the mean, and of the second how many to start and to go on with."""
    fit = lambda of: F.when(of > 0, F.floor(F.lit(limit - overhead) / of)).otherwise(F.lit(0)).cast("bigint")
    sized = statistics.select(
        "doc_id", fit(F.col("max_tokens").cast("double")).alias("conservative"), fit(F.col("mean_tokens") + F.col("stdev_tokens")).alias("recommended"), fit(F.col("mean_tokens")).alias("optimistic"),
    )
    third = F.floor(F.col("recommended") / 3).cast("bigint")
    return sized.select("*", F.least("recommended", F.lit(initial)).cast("bigint").alias("initial"), F.least(third, F.lit(further)).cast("bigint").alias("incremental"))


def call_costs(prompts: DataFrame, text: str = "prompt") -> DataFrame:
    tokens = token_estimate(F.col(text))
    return prompts.select("*", tokens.alias("prompt_tokens"), F.lit(1000).cast("bigint").alias("answer_tokens"), call_cost(tokens).alias("cost_usd"))


def numeric_literals(texts: DataFrame, text: str = "text") -> DataFrame:
    """(decimals, n): numbers in a text by their decimal places, whole ones as 0."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))).alias("number")
    places = F.length(F.regexp_extract("number", r"\.(\d+)$", 1))
    return texts.select(found).groupBy(places.alias("decimals")).agg(F.count(F.lit(1)).alias("n"))


def field_usage(rows: DataFrame, column: str = "json") -> DataFrame:
    """(field, n): how often each top-level field occurs in JSON objects."""
    return rows.select(F.explode(F.json_object_keys(column)).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def renaming_savings(usage: DataFrame, short: DataFrame) -> DataFrame:
    """Characters saved by shorter field names, for each field."""
    return usage.join(F.broadcast(short), "field").select("field", "n", "short", ((F.length("field") - F.length("short")) * F.col("n")).alias("saved"))


def rounding_savings(rows: DataFrame, value: str, places: int) -> DataFrame:
    """Characters of a number's text before and after rounding, and the share saved."""
    before, after = F.length(F.col(value).cast("string")), F.length(F.bround(F.col(value), places).cast("string"))
    return rows.agg(F.sum(before).alias("before"), F.sum(after).alias("after")).withColumn("saved", 1 - F.col("after") / F.col("before"))
