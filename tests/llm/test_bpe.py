import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pagegrain.llm import bpe
from pagegrain.llm.queries import VOCABULARY

TEXTS = [
    "", " ", "\n", "a", "hello world", "it's  what   we'll do\n\n\n", "\t\t x", "x" * 5000, " " * 3000, "12345 " * 700, "é" * 1000 + " ü" * 700, "日本語のテキスト" * 300,
    "a\x1cb \x1d c", "     x", "emoji 🙂🙂 " * 300, "don't" * 900, "".join(chr(32 + i * 7 % 900) for i in range(4000)), "word " * 4000, "\r\n a\r\n" * 500, "!?.,;" * 800,
]


@pytest.fixture(scope="module")
def whole():
    return bpe.load(VOCABULARY, public_tokenizers.PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 7, 64, 1024])
def test_tree_equals_the_whole_encoding(whole, leaf):
    tree = bpe.TokenTree(VOCABULARY, public_tokenizers.PATTERN, leaf)
    for text in TEXTS:
        text = text if leaf > 2 else text[:300]
        ids = tree.encode(text)
        assert ids.tolist() == whole.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()


def test_query_columns_equal_the_library(spark, sf, whole):
    from pagegrain.llm.queries import op7_byte_bpe

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_byte_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = whole.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", 6), (2, "", 7)], "doc_id int, text string, token_ids int")
    out = bpe.decode_ids(bpe.encode_texts(df, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in out.collect()) == [(0, b"a b"), (1, b""), (1, b""), (2, b"")]
    assert bpe.encode_texts(df.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_library_is_the_same(whole):
    assert isinstance(whole, tiktoken.Encoding)
