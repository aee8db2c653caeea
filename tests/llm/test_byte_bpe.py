import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from bidloom.llm import byte_bpe
from data import DOCS, docs
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.read_ranks(PATH)
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [None, "", " ", "plain words here", "naïve ünïcödé \U0001F600\U0001F600", "<|endoftext|>", "a" * 20_000, "x\n\n\n  y\t", "same", "same", "0123456789" * 50]


def test_perfect_hash_is_minimal_and_exact():
    table = {f"k{i}".encode(): i for i in range(3000)}
    perfect = byte_bpe.PerfectHash.build(table)
    assert len(perfect.keys) == len(table)
    assert all(perfect.get(k) == v for k, v in table.items())
    assert perfect.get(b"other") == -1 and byte_bpe.PerfectHash.build({}).get(b"x") == -1


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_merging_equals_the_library(text):
    piece = text.encode()
    if piece:
        assert byte_bpe.merge_bytes(piece, RANKS) == ORACLE._encode_single_piece(piece) or piece in RANKS


def test_encoding_equals_the_library_and_decodes(spark):
    rows = sorted(byte_bpe.encode(docs(spark, TEXTS).repartition(3), PATH, public_tokenizers.PATTERN).collect())
    for row, text in zip(rows, TEXTS):
        ids = ORACLE.encode_ordinary(text or "")
        assert row.token_ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert byte_bpe.decode_ids(ids, RANKS).decode() == (text or "")


def test_empty_table_and_extra_columns(spark):
    assert byte_bpe.encode(spark.createDataFrame([], DOCS), PATH, public_tokenizers.PATTERN).count() == 0
    odd = spark.createDataFrame([(1, "hi", 5)], "doc_id long, text string, n_tokens int")
    assert byte_bpe.encode(odd, PATH, public_tokenizers.PATTERN).first().n_tokens == 1
