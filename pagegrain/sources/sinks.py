"""Tables out: extraction outputs, stages and the info row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stage(df: DataFrame, root: str, base: str, stage: str, form: str = "parquet") -> str:
    """Writes ``{base}_{stage}`` under ``root`` and returns its path."""
    path = f"{root.rstrip('/')}/{base}_{stage}"
    df.write.mode("overwrite").format(form).save(path)
    return path


def write_extraction(tables: dict[str, DataFrame], root: str, base: str) -> dict[str, str]:
    """full_lines, lines, words, compare and info, each a table of its own."""
    return {name: write_stage(df, root, base, name) for name, df in tables.items()}


def info(lines: DataFrame, words: DataFrame, compare: DataFrame) -> DataFrame:
    """One row: pages, lines, words, and the lines of each method."""
    head = lines.agg(F.count_distinct(F.struct("doc_id", "page")).alias("pages"), F.count(F.lit(1)).alias("lines"))
    body = words.agg(F.count(F.lit(1)).alias("words"))
    methods = compare.agg(*[F.count(c).alias(f"by_{c}") for c in ("text", "lines", "words")])
    return head.join(body, how="cross").join(methods, how="cross")
