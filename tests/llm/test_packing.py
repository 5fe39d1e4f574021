import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from phenogrid.llm import packing

REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = packing.WordTokenizer("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")


def ids(text):
    return REFERENCE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "É", "don't", "12", "!!", "日本", " ", " ", "\x1c", "<|endoftext|>", " x", "\U0001f600"]), max_size=12).map("".join), max_size=5))
def test_ids_are_the_tokenizers(texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in WORDS.encode([t.encode() for t in texts])] == [ids(t) for t in texts]


def check(pieces, packed, docs):
    spans = defaultdict(list)
    for r in packed:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    return len(spans)


def test_pieces_and_sequences(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = {r["doc_id"]: ids(r["text"] or "") + [2] for r in df.collect()}
    rows = packing.pack(packing.token_pieces(df)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        part = docs[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    assert set(by) == set(docs)
    for d, parts in by.items():
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert sum(r["length"] for r in parts) == len(docs[d]) and all(r["length"] == 1024 for r in parts[1:])
    used = check(rows, rows, docs)
    assert used <= -(-sum(map(len, docs.values())) // 1024) * 1.02 + 1


@pytest.mark.parametrize("rows", [0, 1, 5000])
def test_rounds_lose_nothing(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "BUCKET_ITEMS", 300)
    df = spark.range(rows).selectExpr("id as doc_id", "cast(1 + pmod(xxhash64(id), 1024) as bigint) as length").repartition(3)
    out = packing.pack(df).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(rows))
    used = check(None, out, None)
    assert used <= -(-sum(r["length"] for r in out) // 1024) * 1.03 + 1


def test_items_that_do_not_go_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ITEMS", 50)
    df = spark.range(400).selectExpr("id as doc_id", "600L as length")
    assert check(None, packing.pack(df).collect(), None) == 400


def test_odd_rows(odd_documents, no_documents):
    rows = packing.pack(packing.token_pieces(odd_documents)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[2][0]["length"] == by[3][0]["length"] == 1 and len(by[8]) == 2 and len(by[5]) > 10
    check(None, rows, None)
    assert packing.pack(packing.token_pieces(no_documents)).count() == 0


def test_added_tokens_stand_for_themselves():
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a <|endoftext|><|endoftext|>b c", "plain words here"]
    assert [np.frombuffer(b, "<u4").tolist() for b in WORDS.encode([t.encode() for t in texts])] == [ids(t) for t in texts]
    assert ids(texts[0]) == [31373, 220, 50256, 995]


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(i, 100, 7, 8, 9, 5) for i in range(30)], "doc_id int, length int, item int, offset int, sequence_id int, bin int")
    out = packing.pack(df)
    assert sorted(out.columns) == ["bin", "doc_id", "item", "length", "offset", "sequence_id"]
    assert {(r["item"], r["bin"]) for r in out.collect()} == {(7, 5)} and out.select("sequence_id").distinct().count() == 3
