import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from laborlens.llm import alignment
from tests.conftest import SF_SMALL
from tests.llm.helpers import empty, odd_documents, pandas_table

os.environ["TOKENIZERS_PARALLELISM"] = "false"


class Whole:
    """Plain alignment of whole texts, link by link."""

    def __init__(self):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(public_tokenizers.path(alignment.A_VOCABULARY))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_VOCABULARY))
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}

    def b_bytes(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(self, text):
        """[(id, begin, end)] of A and B, or None."""
        if not text:
            return None
        raw, out = (" " + text).encode(), []
        for ids, of in ((self.a.encode(" " + text, add_special_tokens=False).ids,
                         lambda i: bytes(self.byte[c] for c in self.a.id_to_token(i))),
                        (self.b.encode(text), self.b_bytes)):
            at, toks = 0, []
            for i in ids:
                toks.append((i, at, at + len(of(i))))
                at = toks[-1][2]
            if b"".join(map(of, ids)) != raw:
                return None
            out.append(toks)
        return out

    def document(self, text):
        """(n_a, n_b, groups as text, links as id pairs)"""
        t = self.tokens(text)
        if t is None:
            return 0, 0, [], []
        a, b = t
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        group = [",".join(str(i) for i, s, e in a if lo <= s and e <= hi) + "|"
                 + ",".join(str(i) for i, s, e in b if lo <= s and e <= hi) for lo, hi in zip([0, *ends], ends)]
        pairs = []
        for i, s, e in a:
            pairs += [(i, j) for j, s2, e2 in b if s < e2 and s2 < e]
        return len(a), len(b), group, pairs


@pytest.fixture(scope="module")
def whole():
    return Whole()


def brute(whole, rows):
    docs = [(i, whole.document(t)) for i, t in rows]
    count = Counter(p for _, d in docs for p in set(d[3]))
    top = Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for i, (n_a, n_b, g, pairs) in docs:
        sha = hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else ""
        out.append((i, n_a, n_b, len(g), len(pairs), sum(count[p] == top[p[0]] for p in pairs),
                    sum(count[p] for p in pairs), sha))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_units_equal_whole_texts(whole):
    import public_tokenizers
    al = alignment.Aligner(*map(public_tokenizers.path, (alignment.A_VOCABULARY, alignment.B_VOCABULARY)))
    import pyarrow as pa
    rng = random.Random(5)
    parts = ["a", "bird", " ", " ", "  ", "\n", "\n\n", "'s", "don't", "\t", "　", "\x85", "é", "日本", "12", ".", ",",
             ">", "</s>", "<0x0A>", "<|endoftext|>", "\r", "\r\n", "{", "}", "ﬁ", "\x00", "😀", "word,", " the", "▁"]
    for _ in range(400):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(8)]
        of = al.numbers(texts, alignment.odd_rows(pa.array(texts), alignment.UNSAFE))
        t = alignment.Tally(al, of)
        for k, text in enumerate(texts):
            want = whole.document(text)
            assert t.ok[k] == bool(want[0]), repr(text)
            if t.ok[k]:
                assert [x[k] for x in t.sums] == [want[0], want[1], len(want[2]), len(want[3])], repr(text)
                assert t.texts[k] == ";".join(want[2]), repr(text)
                own = t.doc == k
                assert dict(zip(t.keys[own].tolist(), t.times[own].tolist())) == Counter(
                    a << 32 | b for a, b in want[3])
            parts_of = [u for part in al.long_numbers(text) for u in part]
            assert alignment.Tally(al, [parts_of]).texts[0] == t.texts[k] or not t.ok[k]


def test_groups_and_links():
    a, b = [2, 5, 6, 9], [1, 6, 7, 9]
    assert alignment.groups(a, b) == ([6, 9], [3, 4], [2, 4])
    ends, i, j = alignment.links(np.asarray(a), np.asarray(b))
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 1), (3, 2), (3, 3)]


def test_odd_rows_equal_brute_force(spark, whole, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 200)
    docs = odd_documents(spark, [("n_a", 1), ("block", 2), ("pair", "x")])
    extra = spark.createDataFrame([(20, "▁ mark"), (21, "a  b\t c\n\n\nd "), (22, " the bird"), (23, "the bird, the 1"),
                                   (23, "the word word word")], "doc_id long, text string")
    got = alignment.align(docs.select("doc_id", "text").union(extra))
    rows = [tuple(r) for r in docs.select("doc_id", "text").union(extra).collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 10_000]
    want = brute(whole, short)
    assert got.columns == [f.split()[0] for f in alignment.ALIGNED.split(", ")]
    # the long text shares pairs with others: it is compared by its own figures
    found = rows_of(got)
    assert len(found) == len(rows)
    own = {r[0]: r for r in found}
    assert own[8][1] > 20_000 and own[8][3] > 0 and own[20][1:] == (0, 0, 0, 0, 0, 0, "")
    assert [r[:5] + r[7:] for r in found if r[0] != 8] == [r[:5] + r[7:] for r in want]
    assert rows_of(alignment.align(docs.union(docs.limit(0)).where("doc_id <> 8").select("doc_id", "text"))) == brute(
        whole, [r for r in rows[:len(rows) - 5] if r[0] not in (8, None)])
    assert alignment.align(empty(spark)).count() == 0


def test_given_table_equals_brute_force(spark, whole):
    t = pandas_table(SF_SMALL, "documents", ["doc_id", "text"])
    few = [(int(i), x) for i, x in zip(t.doc_id, t.text) if len(x) < 6000][:60]
    df = spark.createDataFrame(few, "doc_id long, text string").repartition(5)
    assert rows_of(alignment.align(df)) == brute(whole, few)


def test_very_long_text(spark):
    text = "several words, and more of them; " * 60_000
    got = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_links >= max(got.n_a, got.n_b) and got.n_best == got.n_links == got.count_sum
