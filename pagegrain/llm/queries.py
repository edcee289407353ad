"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import bpe, decontaminate, maskedlm, preference, reshard, simhash, toxicity, urlfilter, vptree, warc
from pagegrain.llm.common import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path)
    return found.select(
        F.col("key").alias("page_id"),
        "payload_bytes",
        F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc_key").alias("doc_id"), "item_id", "matched", "item_shingles")


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against a counterpart that parts from it early, late
    or not at all: one prompt and a pair of completions with what counts."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = preference.assembled(preference.formatted(turns, preference.drafted(turns)))
    spans = [preference.loss_text(F.col(c)).alias(c) for c in ("chosen_loss", "rejected_loss")]
    return pairs.select("pair_id", "piece", "prompt", "chosen", "rejected", *spans)


def op5_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known, values = maskedlm.train(docs)
    return maskedlm.with_pseudo_likelihood(docs, known, values, of_corpus=True).select("doc_id", "n_tokens", "pll", "pll_mean")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_toxicity(docs, model, out="score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode_texts(docs, VOCABULARY, public_tokenizers.PATTERN).select("doc_id", "token_ids")
    both = bpe.decode_ids(ids, VOCABULARY, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.expr("CAST(octet_length(token_ids) / 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 12 shards by key to 16 of equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = scratch_path(spark, "old-shards")
    reshard.write_shards(docs, F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)), F.lit(12)), old)
    return reshard.reshard(spark, old, docs.schema, 12, 16).select(
        "row.doc_id", "size", F.crc32(F.coalesce("row.text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("home").alias("old_shard"), "kept",
    )


def op9_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact: on these vectors a factor that spares work loses neighbours."""
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, factor=1.0)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_decontaminate": op3_decontaminate,
        "op4_preference_format": op4_preference_format,
        "op5_masked_pseudo_likelihood": op5_masked_pseudo_likelihood,
        "op6_toxicity": op6_toxicity,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_flow_reshard": op8_flow_reshard,
        "op9_vantage_point_trees": op9_vantage_point_trees,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.oracle(), "op3_decontaminate": decontaminate.oracle(), "op4_preference_format": preference.oracle(), "op9_vantage_point_trees": vptree.oracle(), "op10_url_filter": urlfilter.oracle()}
