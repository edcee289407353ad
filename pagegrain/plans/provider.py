"""Model providers: a protocol, one that answers from recordings, and the calls."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.errors import ProviderError


@dataclass(frozen=True)
class Answer:
    content: str
    prompt_tokens: int = 0
    completion_tokens: int = 0
    model: str = ""


class Completer(Protocol):
    """Anything that completes a prompt. No provider with a network is built in."""

    def complete(self, prompt: str) -> Answer: ...


class Recorded:
    """Answers from a table of prompt hash and content."""

    def __init__(self, answers: dict[str, str]) -> None:
        self._answers = dict(answers)

    @staticmethod
    def key(prompt: str) -> str:
        return hashlib.sha256(prompt.encode()).hexdigest()

    def complete(self, prompt: str) -> Answer:
        content = self._answers.get(self.key(prompt))
        if content is None:
            raise ProviderError("no recorded answer for this prompt")
        return Answer(content, len(prompt) // 4, len(content) // 4, "recorded")


TEMPLATE = (
    "SYSTEM: You read the layout of documents and answer in JSON only. USER: Below are {n} pages as blocks of lines with position and font. "
    "Tell for each page where header and footer end, and list section headings, figure titles, table titles and contents entries.\n{pages}"
)


def prompts(pages: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(doc_id, prompt) from streamlined blocks: pages in order, as JSON. For a
    sample of pages, whose number is bounded."""
    block = F.struct("block_no", "text_lines", "y0", "x0", "font_name", "font_size")
    page = pages.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    doc = page.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.to_json(F.array_sort(F.collect_list(F.struct("page", "blocks")))).alias("pages"))
    text = F.replace(F.replace(F.lit(template), F.lit("{n}"), F.col("n").cast("string")), F.lit("{pages}"), F.col("pages"))
    return doc.select("doc_id", text.alias("prompt"))


def completed(asked: DataFrame, completer: Completer) -> DataFrame:
    """Adds content, prompt_tokens, completion_tokens and model; calls run on
    the executors, one prompt at a time."""

    def run(frames):
        for frame in frames:
            answers = [completer.complete(p) for p in frame["prompt"]]
            yield frame.assign(content=[a.content for a in answers], prompt_tokens=[a.prompt_tokens for a in answers], completion_tokens=[a.completion_tokens for a in answers], model=[a.model for a in answers])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    extra = [StructField("content", StringType()), StructField("prompt_tokens", LongType()), StructField("completion_tokens", LongType()), StructField("model", StringType())]
    return asked.mapInPandas(run, StructType([*asked.schema.fields, *extra]))
