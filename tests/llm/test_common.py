"""What goes through Python workers, and what comes back."""

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StringType

import corpus_pipeline
from pagegrain.llm import bpe
from pagegrain.llm.common import map_columns
from pagegrain.llm.queries import VOCABULARY


def sent(df):
    """How many columns each Arrow map of the plan gets and of which they are, the last map first."""
    found, nodes = [], [df._jdf.queryExecution().analyzed()]
    while nodes:
        node = nodes.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "MapInArrow":
            of = below[0].references().toSeq()
            found.append((below[0].output().size(), sorted(of.apply(i).name() for i in range(of.size()))))
        nodes += below
    return found


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, "ab", "x"), (2, None, "y"), (None, "", None)], "doc_id int, text string, `a.b` string")


def lengths(*columns):
    return [pa.array([sum(len(x or "") for x in row) for row in zip(*(c.to_pylist() for c in columns))], pa.int64())]


def test_a_column_is_sent_once(df):
    coded = bpe.encode_texts(df, VOCABULARY, public_tokenizers.PATTERN)
    assert sent(coded) == [(3, ["a.b", "doc_id", "text"])]
    both = bpe.decode_ids(coded, VOCABULARY, public_tokenizers.PATTERN)
    assert sent(both)[0] == (4, ["a.b", "doc_id", "text", "token_ids"])
    assert sorted((bytes(r.decoded), r.text or "") for r in both.collect()) == [(b"", ""), (b"", ""), (b"ab", "ab")]


def test_inputs_kept_repeated_replaced_and_dotted(df):
    long = ("n", LongType(), pa.int64())
    out = map_columns(df, ["a.b", "text", "text"], [long], lambda: lengths, weigh="text", most=1)
    assert sorted(out.collect(), key=str) == sorted([(1, "ab", "x", 5), (2, None, "y", 1), (None, "", None, 0)], key=str)
    out = map_columns(df, ["text", "a.b"], [("text", StringType(), pa.string())], lambda: lambda t, b: [pa.array([f"{x}{y}" for x, y in zip(t.to_pylist(), b.to_pylist())])], weigh="text")
    assert out.columns == ["doc_id", "a.b", "text"]
    assert sorted(r.text for r in out.collect()) == ["None", "Noney", "abx"]


def test_texts_stay_out_of_the_decoding_workers(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    decoding, encoding = sent(dict(corpus_pipeline.STAGES)["byte_bpe"](spark, docs, sf))
    assert encoding == (3, ["doc_id", "text", "told"]) and decoding == (3, ["doc_id", "token_ids", "told"])
