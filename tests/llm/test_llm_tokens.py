"""Operator 13 and the encoders against the tokenizers library, on texts made to be hard to cut."""

import random

import pytest
from tokenizers import Tokenizer

from quillon.llm import op03_packing, op07_bpe, op13_tokens
from quillon.llm.bytebpe import fast_ids


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(op07_bpe.vocabulary())


def n(library, text):
    return len(library.encode(text or "", add_special_tokens=False))


PARTS = ["the ", " a", "'ll", "'r", "e", "'", "  ", "\n\n\n", "\t ", "x" * 9, "é", "漢字", "12345", "?!", "<|endoftext|>", "<|endof", "text|>", "🙂", " ", " " * 30, "'s", "\x1c", " "]


@pytest.mark.parametrize(("stride", "overlap"), [(40, 4), (64, 16), (100, 40)])
def test_counts_equal_the_library_wherever_texts_are_cut(spark, library, stride, overlap):
    draw = random.Random(stride)
    texts = ["".join(draw.choices(PARTS, k=draw.choice([0, 3, 30, 200]))) for _ in range(150)] + [None, "", " " * 1000, "a" * 1000, "é" * 999 + " b", "<|endoftext|>" * 60, "'re" * 300, "a b" * 300]
    rows = [(i % 140, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "y"), (None, "a b", "y")]
    got = op13_tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(5), op07_bpe.vocabulary(), limit=60, stride=stride, overlap=overlap)
    want = sorted(((i, len((t or "").encode()), n(library, t), n(library, t) > 60) for i, t, _ in rows), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_a_chunk_with_no_boundary_widens_its_overlap(spark, library):
    texts = ["b " + " " * 5000 + "c d" * 50, "ab" * 3000, "x y " * 900]
    big = spark.createDataFrame(list(enumerate(texts)), "__uid long, text string")
    one = op13_tokens.spliced(op13_tokens.seams(op13_tokens.slices(big, 200, 20), op07_bpe.vocabulary(), 200, 20))
    assert {r[0]: r[1] is None for r in one.collect()} == {0: True, 1: True, 2: False}
    assert {r[0]: r[1] for r in op13_tokens.huge_counts(big, op07_bpe.vocabulary(), 200, 20).collect()} == {i: n(library, t) for i, t in enumerate(texts)}


def test_the_query_at_its_parameters(spark, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op13_tokens.op13_tokens(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: (len((r.text or "").encode()), n(library, r.text), n(library, r.text) > 512) for r in rows}


LONG = [" " * 2_000_000, "\n" * 1_500_000, "a" * 2_000_000, "a b " * 300_000, ("é" * 7 + "\t\n") * 100_000]


@pytest.mark.parametrize("i", range(len(LONG)))
def test_encoders_take_very_long_texts(library, i):
    assert fast_ids(op07_bpe.vocabulary(), LONG[i]).tolist() == library.encode(LONG[i], add_special_tokens=False).ids


def test_operators_take_very_long_texts(spark, library):
    docs = spark.createDataFrame(list(enumerate(LONG[:3])), "doc_id long, text string").repartition(3)
    want = {i: n(library, t) for i, t in enumerate(LONG[:3])}
    assert {r.doc_id: r.n_tokens for r in op13_tokens.token_counts(docs, op07_bpe.vocabulary()).collect()} == want
    assert {r.doc_id: r.n_tokens for r in op07_bpe.round_trip(docs, op07_bpe.vocabulary()).collect()} == want
    pieces = op03_packing.pack(docs, op07_bpe.vocabulary()).select("doc_id", "length").groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] - 1 for r in pieces} == want


def test_token_counts_of_an_empty_table_and_of_a_clashing_key(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op13_tokens.token_counts(empty, op07_bpe.vocabulary()).collect() == []
    with pytest.raises(ValueError):
        op13_tokens.token_counts(empty.withColumnRenamed("doc_id", "n_bytes"), op07_bpe.vocabulary(), key="n_bytes")
