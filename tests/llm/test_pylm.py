import math
import zlib
from collections import Counter

import numpy as np
import pytest

from laborlens.llm import pylm, queries
from tests.conftest import SF_SMALL
from tests.llm.helpers import empty, odd_documents, pandas_table


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def test_counts_and_base_score(spark):
    docs = pandas_table(SF_SMALL, "documents", ["doc_id", "text"])
    rows = queries.op10(spark, SF_SMALL).toPandas().set_index("doc_id")
    assert len(rows) == len(docs)
    counts = Counter()
    for i, t in zip(docs.doc_id, docs.text):
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in zip(docs.doc_id, docs.text):
        own, r = tokens(t), rows.loc[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(own), n, sum(counts[w] > 0 for w in own))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + .1) / (n + .1 * (v + 1))) for w in own))
    assert (rows.score < 0).all()


def test_model_beats_the_base_on_held_out_text(spark):
    rows = queries.op10(spark, "/root/testdata/sf0.1").toPandas()
    held = rows[rows.held_out]
    assert held.score.sum() > held.base_score.sum()


def rooms(words, low=0, depth=pylm.DEPTH, sweeps=4):
    cell = pylm.shortened(pylm.spelled(words)[1], depth)
    cells, n = np.unique(cell, return_counts=True)
    r = pylm.Rooms(cells, n, low, depth, [0.5, 0.4, 0.3, 0.6, 0.5])
    r.fill(None)
    base = np.full(len(r.cells[low]), 1 / 256)
    for k in range(sweeps):
        r.seat(base, k)
        for j in range(low, depth + 1):
            assert (r.t[j] >= 1).all() and (r.t[j] <= r.c[j]).all()
        assert all((np.bincount(r.up[j], r.t[j]) == r.c[j - 1]).all() for j in range(low + 1, depth + 1))
    return r


WORDS = [b"stone", b"stones", b"tone", b"ton", b"", b"abcabc"] * 4


def test_spelling_equals_the_recursion():
    """Every known cell's probability equals that of the restaurants, customer by customer."""
    r = rooms(WORDS)

    def slow(cell, k):
        if k < 0:
            return 1 / 256
        code = int(pylm.shortened(np.asarray([cell]), k)[0])
        own = {int(c): i for i, c in enumerate(r.cells[k])}
        here = [i for c, i in own.items() if c >> 8 == code >> 8]
        customers, tables = sum(int(r.c[k][i]) for i in here), sum(int(r.t[k][i]) for i in here)
        i = own[code]
        return (r.c[k][i] - r.d[k] * r.t[k][i] + (pylm.STRENGTH + r.d[k] * tables) * slow(cell, k - 1)) \
            / (pylm.STRENGTH + customers)

    a, b = r.predictive()[pylm.DEPTH]
    want = [slow(int(c), pylm.DEPTH) for c in r.cells[pylm.DEPTH]]
    assert np.allclose(a + b / 256, want)


def test_spelling_is_a_distribution():
    """After each context the known bytes and the weight left for all others sum to one at every length."""
    r = rooms(WORDS)
    p = {k: a + b / 256 for k, (a, b) in r.predictive().items()}
    for k in range(1, pylm.DEPTH + 1):
        customers, tables = r._sums(k)
        for room in np.unique(r.room[k]):
            own = r.room[k] == room
            left = (pylm.STRENGTH + r.d[k] * tables[own][0]) / (pylm.STRENGTH + customers[own][0])
            assert p[k][own].sum() + left * (1 - p[k - 1][r.up[k][own]].sum()) == pytest.approx(1)


def word_block(counts, seed=3):
    """A block of words with counts by context: {word: {z: n}}."""
    words = sorted(counts)
    size = np.asarray([len(counts[w]) for w in words], "u1")
    z = np.asarray([c for w in words for c in sorted(counts[w])], "u1")
    n = np.asarray([counts[w][c] for w in words for c in sorted(counts[w])], "<i8")
    starts, cell = pylm.spelled(words)
    cells, place = np.unique(cell, return_inverse=True)
    length = np.diff(np.append(starts, len(cell))).astype("<i4")
    seeds = np.asarray([zlib.crc32(w) * 7919 + seed for w in words], "<u8")
    return pylm.Words(seeds.tobytes(), size.tobytes(), z.tobytes(), n.tobytes(), length.tobytes(),
                      place.astype("<i4").tobytes()), words, cells


def model_of(words, t, t0):
    x = np.asarray(words.sums(t, t0), float)
    one = 1 << pylm.BITS
    return {"customers": x[:one], "tables": x[one:2 * one], "d": 0.4, "d0": 0.6, "customers0": x[2 * one + 4],
            "tables0": x[2 * one + 5]}


def test_word_probabilities_sum_to_one_in_every_context():
    """All words of the vocabulary, and what is left for the rest, after any seating."""
    counts = {b"the": {0: 40, 1: 3, 5: 1}, b"of": {0: 7, 2: 2}, b"cat": {1: 1}, b"": {5: 9}, b"dog": {3: 0}}
    words, names, cells = word_block(counts)
    g = np.asarray([0.01, 0.2, 0.03, 0.05, 0.001])
    t = np.minimum(words.n, 1)
    t0 = np.minimum(words.per_word(t), 1)
    for sweep in range(4):
        m = model_of(words, t, t0)
        p = words.predictive(t, t0, m, g)
        of = dict(zip(zip(words.row.tolist(), words.z.tolist()), p))
        c0 = words.per_word(t)
        p0 = (c0 - m["d0"] * t0 + (1 + m["d0"] * m["tables0"]) * g) / (1 + m["customers0"])
        for z in range(1 << pylm.BITS):
            weight = (1 + m["d"] * m["tables"][z]) / (1 + m["customers"][z])
            rest = weight * (1 + m["d0"] * m["tables0"]) / (1 + m["customers0"]) * (1 - g.sum())
            total = sum(of.get((w, z), weight * p0[w]) for w in range(len(names)))
            assert total + rest == pytest.approx(1)
        t, t0 = words.seat(t, t0, m, g, sweep)
        assert (t <= words.n).all() and ((t > 0) == (words.n > 0)).all()
        c0 = words.per_word(t)
        assert (t0 <= c0).all() and ((t0 > 0) == (c0 > 0)).all()


def test_seating_equals_a_plain_sampler():
    """Mean tables of one dish, given the others: against customers seated one at a time."""
    counts = {b"a": {0: 30}, b"b": {0: 12, 1: 5}}
    g = np.asarray([0.1, 0.2])
    ours, plain = [], []
    rng = np.random.default_rng(1)
    for k in range(3000):
        words, _, _ = word_block(counts, seed=k)
        t, t0 = np.asarray([4, 3, 2]), np.asarray([2, 2])
        m = model_of(words, t, t0)
        ours.append(words.seat(t, t0, m, g, 1)[0])
        # dish (a, 0): its own 4 tables leave; b's 5 tables stay
        p0 = (0 - 0 + (1 + 0.6 * (4 - 2)) * 0.1) / (1 + 9 - 4)
        n = tables = 0
        for _ in range(30):
            strength = (1 + 0.4 * (7 - 4)) * p0 if tables else 1
            tables += 1 if not n else int(rng.random() < strength / (strength + n - 0.4 * tables))
            n += 1
        plain.append(tables)
    assert np.mean(np.asarray(ours)[:, 0]) == pytest.approx(np.mean(plain), rel=0.05)


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(300).select("doc_id", "text")
    one = pylm.score(docs.repartition(1)).toPandas().sort_values("doc_id")
    monkeypatch.setattr(pylm, "BLOCK_WORDS", 2000)
    monkeypatch.setattr(pylm, "WORDS", 3000)
    monkeypatch.setattr(pylm, "RANGE_BITS", 25)          # several ranges of document blocks
    many = pylm.score(docs.repartition(7)).toPandas().sort_values("doc_id")
    assert np.allclose(one.base_score, many.base_score) and (one.n_known.to_numpy() == many.n_known.to_numpy()).all()
    assert np.allclose(one.score, many.score, rtol=2e-3)


def test_table_draws_match_the_restaurant_process():
    """Mean number of tables of n customers with strength a (discount 0): sum a / (a + i)."""
    key = np.arange(4000, dtype=np.uint64)
    for n in (1, 2, 10, 1000):
        t = pylm.sample_tables(np.full(4000, n), np.full(4000, 2.0), 0.0, key)
        assert t.mean() == pytest.approx(1 + sum(2 / (2 + i) for i in range(1, n)), rel=0.05)


def test_poisson_draws():
    key = np.arange(20000, dtype=np.uint64)
    for mean in (0.3, 4.0, 25.0, 80.0):
        x = pylm.poisson(np.full(len(key), mean), key, 5)
        assert x.mean() == pytest.approx(mean, rel=0.03) and x.var() == pytest.approx(mean, rel=0.06)


def test_a_context_is_the_word_before():
    assert pylm.contexts(np.asarray([3, 4, 0, 3, 0, 0]), 0).tolist() == [0, 3, 4, 0, 3, 0]


def test_preceding_words_count(spark):
    """A word is likelier after the long word that it always follows than after others (no class of short words tells them apart)."""
    rows = [(k, f"{a} {b}") for k in range(1, 301) for a, b in [(("northern", "lights"), ("southern", "comfort"))[k % 2]]]
    rows += [(1001, "northern lights"), (1002, "southern lights"), (1003, "southern comfort"), (1004, "northern comfort")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p = pylm.score(docs, train=docs.doc_id < 1000).toPandas().set_index("doc_id").score
    assert p[1001] > p[1002] + 1 and p[1003] > p[1004] + 1


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(pylm, "BLOCK_WORDS", 5)           # several blocks a task
    monkeypatch.setattr(pylm, "TEXTS", 2)
    rows = pylm.score(odd_documents(spark, [("block", 1), ("n", "x")])).toPandas()
    assert len(rows) == 10
    assert (rows[rows.doc_id.isin([1, 2, 3])].n_tokens == 1).all()
    same = rows[rows.doc_id.isin([5, 6])]
    assert len(same) == 3 and np.isfinite(rows.score).all()
    assert pylm.score(empty(spark)).count() == 0


def test_without_training_rows(spark):
    from pyspark.sql import functions as F
    rows = pylm.score(odd_documents(spark), train=F.lit(False)).toPandas()
    assert (rows.train_tokens == 0).all() and np.allclose(rows.base_score, 0) and (rows.n_known == 0).all()
    assert (rows.score < 0).all()
