"""Composite plans: what a document looks like, from its lines alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.operators import blocks, boundaries, patterns, spacing
from pagegrain.params import DEFAULTS, LayoutParams


def analyze_spacing(lines: DataFrame, params: LayoutParams = DEFAULTS) -> dict[str, DataFrame]:
    histogram, common = spacing.line_spacing(lines, params)
    gaps = spacing.gap_histogram(spacing.gap_samples(lines, params))
    return {
        "line_spacing": histogram, "common": common, "paragraph_candidates": spacing.paragraph_candidates(histogram, common, params),
        "paragraphs": spacing.paragraph_spacing(lines, params), "gaps": gaps, "rules": spacing.spacing_rules(gaps, params),
    }


def analyze_boundaries(lines: DataFrame, params: LayoutParams = DEFAULTS) -> dict[str, DataFrame]:
    rules = spacing.spacing_rules(spacing.gap_histogram(spacing.gap_samples(lines, params)), params)
    found = boundaries.traditional(lines, params).unionByName(boundaries.contextual(lines, rules, params))
    return {"candidates": found, "boundaries": boundaries.final_boundaries(lines, found)}


def document_summary(lines: DataFrame, params: LayoutParams = DEFAULTS) -> DataFrame:
    """One row per document: pages, body font, commonest gap, blocks, and the
    boundaries of its content by the contextual method."""
    gaps = spacing.with_gaps(lines)
    rules = spacing.spacing_rules(spacing.gap_histogram(spacing.gap_samples(gaps, params)), params)
    _, common = spacing.line_spacing(gaps, params)
    counted = blocks.numbered_lines(gaps, rules).groupBy("doc_id").agg(F.count_distinct(F.struct("page", "block_no")).alias("n_blocks"))
    edges = boundaries.final_boundaries(gaps, boundaries.contextual(gaps, rules, params)).where("method = 'contextual'").drop("method")
    out = patterns.document_context(gaps)
    for part in (common, counted, edges):
        out = out.join(part, "doc_id", "left")
    return out.withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))
