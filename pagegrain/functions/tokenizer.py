"""Exact token counts, where a tokenizer is at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Encoding and context tokens of known model families.
MODELS = {
    "gpt-4.1": ("o200k_base", 1048576),
    "gpt-4o": ("o200k_base", 128000),
    "gpt-4": ("cl100k_base", 128000),
    "gpt-4-turbo": ("cl100k_base", 128000),
    "gpt-3.5-turbo": ("cl100k_base", 16385),
}


def exact_tokens(text: Column, make: Callable[[], Callable[[str], int]]) -> Column:
    """Tokens of each text. ``make`` runs once per batch iterator on the
    executors and returns the function that counts."""

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counted = make()
        for batch in batches:
            yield batch.map(lambda t: None if t is None else counted(t)).astype("Int64")

    return count(text)


def context_of(model: str) -> int:
    """Context tokens of a model by the longest family name it starts with."""
    known = [m for m in MODELS if model.startswith(m)]
    if not known:
        raise ValueError(f"unknown model {model!r}; known: {', '.join(MODELS)}")
    return MODELS[max(known, key=len)][1]
