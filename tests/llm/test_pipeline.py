"""Stages against brute force on the smallest tables, and on awkward rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagegrain.llm import bpe, toxicity
from pagegrain.llm.queries import VOCABULARY
from tests.llm.test_decontaminate import slow
from tests.llm.test_simhash import slow_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "byte_bpe"]


def test_toxicity_keeps_what_it_scores_low(spark, sf, docs):
    kept = stage("toxicity")(spark, docs, sf)
    assert kept.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in toxicity.with_toxicity(docs, model).where(F.col("toxicity") < 0.5).collect()}
    assert {r.doc_id for r in kept.collect()} == want


def test_one_of_each_group_stays(spark, sf, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    groups, _ = slow_groups([t for _, t in rows])
    kept = stage("simhash_near_dedup")(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [rows[i][0] for i in sorted(set(groups))]


def test_contaminated_documents_go(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = stage("decontamination")(spark, docs, sf)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in rows} - {k for k, *_ in slow(rows, items)}


def test_encoding_decodes(spark, sf, docs):
    tree = bpe.TokenTree(VOCABULARY, public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in docs.collect()}
    import numpy as np

    rows = stage("byte_bpe")(spark, docs, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tree.decode(np.frombuffer(r.token_ids, "<u4")).decode() == texts[r.doc_id] and r.n_tokens * 4 == len(r.token_ids)


def test_awkward_rows_and_nothing(spark, sf):
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "fine words here", "en", "s", 3), (None, "fine words there now", "en", "s", 3)], SCHEMA)
    for df, most in ((odd, 5), (odd.limit(0), 0)):
        for name, f in corpus_pipeline.STAGES[:-1]:
            df = f(spark, df, sf)
            assert df.columns == odd.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() == df.count() <= most


def test_clashing_names(spark, sf):
    shape = SCHEMA + ", toxicity double, __toxicity double, __hash long, h long, k1 long, k2 long, k long, s long, row string, __k long"
    odd = spark.createDataFrame([(1, "fine words here", "en", "s", 3, 9.0, 9.0, 1, 2, 3, 4, 5, 6, "r", 7), (2, None, None, None, None, *[None] * 10)], shape)
    for name, f in corpus_pipeline.STAGES[:-1]:
        kept = f(spark, odd, sf)
        assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect())), name


def test_run_applies_all_stages(spark, sf):
    assert {"doc_id", "n_tokens", "token_ids"} == set(corpus_pipeline.run(spark, sf).columns)


def test_encoding_stops_where_ids_do_not_give_back_the_text(spark, sf, monkeypatch):
    df = spark.createDataFrame([(1, "fine words", "en", "s", 10), (2, None, None, None, None)], SCHEMA)
    assert len(stage("byte_bpe")(spark, df, sf).collect()) == 2
    decode = bpe.decode_ids
    monkeypatch.setattr(bpe, "decode_ids", lambda *a: decode(*a).withColumn("decoded", F.concat("decoded", F.lit(b"x"))))
    with pytest.raises(Exception, match="give back the text of document"):
        stage("byte_bpe")(spark, df, sf).collect()
