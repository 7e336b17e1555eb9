import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldspan.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


ENCODER = packing.Encoder(packing.tokenizer_path())
REAL = Tokenizer.from_file(packing.tokenizer_path())


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list("abcéßZ'sdm <|>\n\t\x1c .,1²_İΣǄ­日́")), st.characters(codec="utf-8")), max_size=60))
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == REAL.encode(text, add_special_tokens=False).ids


def test_special_strings(tokenizer):
    text = "<|endoftext|> a<|startoftext|>b don't we'LL"
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000, 1_000_001])
def test_lengths_are_powers_of_two(n):
    found = packing.lengths(n)
    assert sum(found) == n and all(x & (x - 1) == 0 and x <= 2048 for x in found) and found == sorted(found, reverse=True)


def test_pieces_rebuild_every_document(spark, texts, tokenizer):
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").withColumnsRenamed({"lang": "length", "source": "ids"})
    rows = packing.pack(df, with_ids=True).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 and len(r["ids"]) == r["length"] == 1 << r["bucket"] for r in rows)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    for doc_id, text, *_ in texts:
        own = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"])
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        times = sum(x[0] == doc_id for x in texts)
        assert sum(r["length"] for r in own) == len(ids) * times and all(r["doc_tokens"] == len(ids) for r in own)
        if times == 1:
            assert [i for r in own for i in r["ids"]] == ids
            assert [r["start"] for r in own] == list(np.cumsum([0, *[r["length"] for r in own[:-1]]]))


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_buckets_are_written(spark, tmp_path):
    packing.write_buckets(spark.createDataFrame([(1, "a b c " * 700)], "doc_id long, text string"), str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.selectExpr("sum(length) as n").first()["n"] == 2101 and found.filter("length <> 1 << bucket").count() == 0
