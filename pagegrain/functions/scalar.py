"""Scalar functions: rounding, white space, names and estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, step: float) -> Column:
    """The nearest multiple of ``step``, halves to even."""
    return F.rint(value / F.lit(step)) * F.lit(step)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def normalize_line(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


# Stage suffixes in the order in which they are tried.
SUFFIXES = ("_lines", "_full_lines", "_words", "_compare", "_info")


def base_name(path: Column) -> Column:
    """File name without folder, extension and the first suffix that fits."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    cut = [F.when(F.endswith(stem, F.lit(s)), F.substring(stem, F.lit(1), F.length(stem) - len(s))) for s in SUFFIXES]
    return F.coalesce(*cut, stem)


def confidence(word: Column) -> Column:
    """High, Medium or Low from free wording; Low for anything else."""
    w = F.lower(strip(F.coalesce(word, F.lit(""))))
    return F.when(w.isin("high", "h"), "High").when(w.isin("medium", "med", "m"), "Medium").otherwise("Low")


def token_estimate(text: Column, chars_per_token: float = 4) -> Column:
    return F.floor(F.length(text) / F.lit(chars_per_token)).cast("bigint")


def call_cost(prompt_tokens: Column, answer_tokens: int = 1000, prompt_price: float = 0.03, answer_price: float = 0.06) -> Column:
    """Price of a call in dollars; prices are per thousand tokens."""
    return prompt_tokens / 1000 * prompt_price + answer_tokens / 1000 * answer_price


def range_label(low: Column, high: Column) -> Column:
    """``≤ x``, ``≥ x``, ``x`` or ``a - b`` for a range with open ends."""
    text = lambda c: F.format_string("%.2f", c)
    return (
        F.when(low.isNull(), F.concat(F.lit("≤ "), text(high))).when(high.isNull(), F.concat(F.lit("≥ "), text(low)))
        .when(low == high, text(low)).otherwise(F.concat(text(low), F.lit(" - "), text(high)))
    )


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A template with ``{key}`` replaced by values."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template)


def prompt_parts(prompt: Column) -> Column:
    """(system, user): parted at the first ``USER:`` if both marks are there."""
    at = F.locate("USER:", prompt)
    whole = F.struct(F.lit(None).cast("string").alias("system"), prompt.alias("user"))
    head = F.replace(F.substring(prompt, F.lit(1), at - 1), F.lit("SYSTEM:"), F.lit(""))
    cut = F.struct(strip(head).alias("system"), strip(F.substring(prompt, at + 5, F.length(prompt))).alias("user"))
    return F.when((at > 0) & F.contains(prompt, F.lit("SYSTEM:")), cut).otherwise(whole)
