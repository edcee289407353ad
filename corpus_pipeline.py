"""The corpus pipeline: four stages over ``documents``.

Toxic documents go, one document of each near-duplicate group stays, documents
that hold a benchmark item go, and what remains is encoded. Each stage works on
all that its predecessor kept; all but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import bpe, decontaminate, simhash, toxicity
from pagegrain.llm.common import free_name, remove, written
from pagegrain.llm.queries import VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose probability of being toxic is below one half."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "toxicity")
    return toxicity.with_toxicity(docs, model, out=score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the smallest
    doc_id: SimHash finds the candidates, five-word shingles decide."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold less than 0.8 of every item's shingles."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every document that is left. All ids are
    decoded again; a text that they don't give back, as its SHA-256 tells, stops
    the run. So the texts themselves don't go through the decoding workers."""
    told = F.sha2(F.coalesce("text", F.lit("")), 256).alias("told")
    coded = bpe.encode_texts(docs.select("doc_id", told, "text"), VOCABULARY, public_tokenizers.PATTERN).drop("text")
    both = bpe.decode_ids(coded, VOCABULARY, public_tokenizers.PATTERN)
    same = F.sha2("decoded", 256) == F.col("told")
    proven = F.when(same, F.col("token_ids")).otherwise(F.raise_error(F.concat(F.lit("ids do not give back the text of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("binary"))
    return both.select("doc_id", F.expr("CAST(octet_length(token_ids) / 4 AS BIGINT)").alias("n_tokens"), proven.alias("token_ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: No stage but the third can be put in SQL: the first trains a classifier, the
#: second needs seeded XXH64 and the last byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
