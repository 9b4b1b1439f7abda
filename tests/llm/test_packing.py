import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from laborlens.llm import packing
from tests.conftest import SF_SMALL
from tests.llm.helpers import empty, odd_documents, pandas_table


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def check_layout(rows, capacity):
    """Every sequence is gapless from 0 and within the capacity."""
    for _, g in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
        assert g["length"].sum() <= capacity


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=300))
def test_plan_places_every_piece_once(lengths):
    cap = 60
    counts = np.bincount(lengths, minlength=cap + 1)
    bins: dict = {}
    given_out = np.zeros(cap + 1, int)
    for n, first, per, many, bin0, offset in packing.plan(counts, cap).tolist():
        assert first == given_out[n]
        given_out[n] += per * many
        for b in range(bin0, bin0 + many):
            bins.setdefault(b, []).extend((offset + i * n, n) for i in range(per))
    assert (given_out == counts).all()
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= cap
        assert sum(n > cap // 3 for _, n in parts) <= 2
    assert len(bins) <= 2 * -(-sum(lengths) // cap)       # never worse than half full


@pytest.mark.parametrize("text", ["THE cat, don't!! (it's) É!", "a\x1cb ½²ª İ ﬁ ΣΑΣ", "<|ENDOFTEXT|> <|endoftext|>x",
                                  "", " \n ", "l'été; über-groß… “q”", "x" * 5000, "aʼs 's'LL 1234"])
def test_word_ids_equal_the_tokenizer(text):
    import public_tokenizers
    import pyarrow as pa
    ids, ends = packing.WordIds(public_tokenizers.path(packing.TOKENIZER)).encode(pa.array([text, None, text]))
    want = tokenizer().encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and ends.tolist() == [len(want), len(want), 2 * len(want)]


def test_round_trip_on_documents(spark):
    docs = pandas_table(SF_SMALL, "documents", ["doc_id", "text"])
    rows = packing.pack(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).toPandas()
    check_layout(rows, 2048)
    tok = tokenizer()
    by_id = {k: g.sort_values("piece") for k, g in rows.groupby("doc_id")}
    for doc, text in zip(docs.doc_id, docs.text):
        ids = tok.encode(text, add_special_tokens=False).ids + [0]
        cuts = [ids[k:k + 2048] for k in range(0, len(ids), 2048)]
        g = by_id[doc]
        assert g["length"].tolist() == [len(c) for c in cuts]
        assert g["start"].tolist() == [2048 * k for k in range(len(cuts))]
        assert g["ids_crc32"].tolist() == [zlib.crc32(np.asarray(c, "<u4").tobytes()) for c in cuts]
    assert rows["sequence_id"].nunique() <= 1.02 * -(-rows["length"].sum() // 2048) + 1


def test_odd_rows(spark):
    docs = odd_documents(spark, [("piece", 9), ("length", "x"), ("_rank", 1)])
    rows = packing.pack(docs).toPandas()
    check_layout(rows, 2048)
    assert rows[rows.doc_id.isin([1, 2, 3])]["length"].tolist() == [1, 1, 1]
    assert (rows.doc_id == 5).sum() == 2 and rows.doc_id.isna().sum() == 1
    assert sorted(rows[rows.doc_id == 8]["piece"]) == list(range((rows.doc_id == 8).sum()))
    assert packing.pack(empty(spark)).count() == 0
