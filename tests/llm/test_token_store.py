import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from laborlens.llm import token_store
from laborlens.session import scratch_path
from tests.conftest import SF_SMALL
from tests.llm.helpers import empty, odd_documents, pandas_table

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))


def brute(tokenizer, rows):
    """{(doc_id, start, n, crc)} in ascending order of the id; rows of equal ids in any order."""
    ids = [(i, np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t in rows]
    return [(i, len(a), zlib.crc32(a.tobytes())) for i, a in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0))]


def check(got, want):
    """Starts are gapless, ids ascend, and each id has the expected rows."""
    rows = sorted((tuple(r) for r in got.select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    at = 0
    for start, _, n, _ in rows:
        assert start == at
        at += n
    ids = [r[1] for r in rows]
    assert ids == [w[0] for w in want]
    assert sorted((r[1:] for r in rows), key=str) == sorted(want, key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 64 - 1), max_size=300))
def test_perfect_hash_is_minimal(values):
    h = np.asarray(values + values[:3], np.uint64)             # some equal hashes
    keys = np.zeros(len(h), token_store.LISTED)
    keys["doc_id"] = np.arange(len(h))
    slots = np.zeros(len(h), token_store.SLOT)
    slots["print"], slots["at"] = np.arange(len(h)) * 7, np.arange(len(h))
    part = token_store.IndexPart.from_bytes(token_store.IndexPart.of(h, keys, slots).to_bytes())
    at = part.find(h, slots["print"], keys)
    assert sorted(at.tolist()) == list(range(len(h)))
    assert (part.slots["at"][at] == slots["at"]).all()
    wrong = part.find(h, slots["print"] + np.uint32(1), keys)
    assert (wrong == -1).all()


def test_given_table(spark, tokenizer):
    t = pandas_table(SF_SMALL, "documents", ["doc_id", "text"])
    got = token_store.round_trip(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    check(got, brute(tokenizer, list(zip(t.doc_id.tolist(), t.text))))


def test_repeated_ids_over_shards(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_store, "LEAST_SHARD", 40)
    monkeypatch.setattr(token_store, "PART_KEYS", 20)
    rows = [(7, f"text {k % 40}") for k in range(120)] + [(None, f"none {k}") for k in range(30)] + \
           [(k, "word " * k) for k in range(30)] + [(-5, "<|endoftext|> x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    store = token_store.write(df, scratch_path(spark, "store"))
    shards = store.shards(spark).collect()
    assert len(shards) > 4 and sum(r.n_docs for r in shards) == len(rows)
    keys = store.keys(spark).collect()
    assert len(set(keys)) == len(rows) and {r.nth for r in keys if r.doc_id == 7} == set(range(121))
    check(token_store.read(store, token_store.find(store, store.keys(spark))), brute(tokenizer, rows))
    assert token_store.ids_of(store, spark, 3).tolist() == tokenizer.encode("word word word ").ids + [2]
    assert token_store.ids_of(store, spark, 12345) is None and token_store.ids_of(store, spark, 3, 1) is None


def test_odd_rows(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_store, "READ_BYTES", 400)
    docs = odd_documents(spark, [("n", 1), ("shard", 2), ("ids", "x"), ("tie", "y")])
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(token_store.round_trip(docs), brute(tokenizer, rows))
    assert token_store.round_trip(empty(spark)).count() == 0


def test_very_long_text(spark, tokenizer):
    rows = [(1, "many words in a row, and signs.\n" * 80_000), (2, "   \n\n\n  " * 50_000 + "x")]
    check(token_store.round_trip(spark.createDataFrame(rows, "doc_id long, text string")), brute(tokenizer, rows))


def test_each_different_piece_of_many_texts_is_looked_up_once(tokenizer, monkeypatch):
    """Ids of texts encoded together equal the tokenizer's, in one slice or many, whatever cuts them."""
    import pyarrow as pa
    from laborlens.llm import byte_bpe
    texts = ["a cat a cat a cat", "cat a\ncat, don't", "", None, " lead", "\nline\n\nend ", "x  two   three", "é naïve 日本 😀",
             "a<|endoftext|> cat", "long " * 40]
    want = [np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    ids = byte_bpe.ByteIds(byte_bpe.tokenizer_path(token_store.TOKENIZER))
    asked = []

    class Asked(dict):
        def __missing__(self, piece):
            return ids.chunk(byte_bpe.chunk_of(piece))

        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece) if piece in self else self.__missing__(piece)

        def turn(self):
            pass

    ids.pieces = Asked()
    assert ids.encode(pa.array(texts)) == want
    assert len(asked) == len(set(asked))
    ids = byte_bpe.ByteIds(byte_bpe.tokenizer_path(token_store.TOKENIZER))
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 8)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 30)
    assert ids.encode(pa.array(["first", *texts]).slice(1)) == want
