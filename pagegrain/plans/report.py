"""The text report of a document: small aggregates as ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.operators import spacing


def report_lines(lines: DataFrame, top: int = 10) -> DataFrame:
    """(section, rank, line): the commonest fonts, sizes and gaps over all documents."""
    gaps = spacing.gap_histogram(spacing.gap_samples(lines))
    parts = (
        ("fonts", lines.groupBy(F.col("predominant_font").alias("v"))), ("sizes", lines.groupBy(F.format_string("%.1f pt", "predominant_size").alias("v"))),
        ("gaps", gaps.groupBy(F.format_string("%.1f pt", "gap").alias("v"))),
    )
    out = None
    for name, grouped in parts:
        counted = grouped.agg((F.sum("cnt") if name == "gaps" else F.count(F.lit(1))).alias("n"))
        best = counted.orderBy(F.desc("n"), "v").limit(top)
        told = best.select(F.lit(name).alias("section"), F.format_string("%s: %d", "v", "n").alias("line"))
        out = told if out is None else out.unionByName(told)
    return out
