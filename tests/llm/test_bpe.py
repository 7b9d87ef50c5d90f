import hashlib

import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tributary.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "it's  we'll\n\n x", "<|endoftext|> a<|endoftext|>", "ab" * 4000, "é" * 500, " 　\u0085x", "𝕏 q 12³4", None, "same", "same"]


@pytest.fixture(scope="module")
def expected():
    t = Tokenizer.from_file(PATH)
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]
    return ids, [t.decode(i, skip_special_tokens=False) for i in ids]


def test_round_trip_equals_the_library(spark, expected):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("TEXT", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
    docs = spark.createDataFrame([(i if i else None, "other", t, "clash") for i, t in enumerate(TEXTS)], schema)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert len(got) == len(TEXTS)
    for i, (ids, text) in enumerate(zip(*expected)):
        r = got[i if i else None]
        assert list(memoryview(bytes(r.ids)).cast("I")) == ids and r.n_tokens == len(ids) and r.text == text


def test_long_words_take_the_same_merges(monkeypatch):
    b = bpe.ByteBpe(PATH)
    word = ("banana" * 30 + "zq" * 20).encode()
    long = b.merge(word)
    monkeypatch.setattr(bpe, "LONG_WORD", 10**9)
    assert b.merge(word) == long


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, PATH), PATH).count() == 0


def test_query_on_the_small_table(spark):
    from tributary.llm.registry import QUERIES

    t = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op8_bpe_codec"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
