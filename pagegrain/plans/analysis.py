"""From lines to a model's answers: sample, prune, ask, parse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.functions.scalar import call_cost, token_estimate
from pagegrain.operators import answers, blocks, sampling, spacing
from pagegrain.params import DEFAULTS, LayoutParams
from pagegrain.plans import provider


def sampled_prompts(lines: DataFrame, params: LayoutParams = DEFAULTS, seed: int = 42) -> DataFrame:
    """(doc_id, prompt) for the header and footer sample of every document."""
    rules = spacing.spacing_rules(spacing.gap_histogram(spacing.gap_samples(lines, params)), params)
    picked = sampling.groups_sample(lines.select("doc_id", "page").distinct(), seed=seed).select("doc_id", "page")
    body = blocks.streamlined(blocks.blocks(blocks.numbered_lines(lines, rules)))
    return provider.prompts(body.join(picked, ["doc_id", "page"], "left_semi"))


def estimated_cost(prompts: DataFrame) -> DataFrame:
    tokens = token_estimate(F.col("prompt"))
    return prompts.select("doc_id", tokens.alias("prompt_tokens"), call_cost(tokens).alias("cost_usd"))


def asked(prompts: DataFrame, completer: provider.Completer) -> DataFrame:
    """Answers, parsed; those that can't be read keep their problems."""
    return answers.parsed(provider.completed(prompts, completer).withColumnRenamed("doc_id", "answer_id"))


def status(completer: provider.Completer | None, found: DataFrame | None) -> dict[str, object]:
    return {"configured": completer is not None, "answers": 0 if found is None else found.count()}
