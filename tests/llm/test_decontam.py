import re
from collections import Counter

import numpy as np

from laborlens.llm import decontam
from tests.conftest import SF_SMALL
from tests.llm.helpers import empty, odd_documents, pandas_table


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def shingles(w):
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def slow_matches(text, item):
    """Starts of item-sized windows with similarity >= 0.8."""
    w, s = words(text), shingles(words(item))
    n = len(words(item))
    out = []
    for a in range(max(1, len(w) - n + 1)):
        t = shingles(w[a:a + n])
        both = sum((s & t).values())
        total = sum(s.values()) + sum(t.values()) - both
        if s and total and both / total >= 0.8:
            out.append(a)
    return out


def test_documents_equal_brute_force(spark):
    docs = pandas_table(SF_SMALL, "documents", ["doc_id", "text"])
    items = pandas_table(SF_SMALL, "benchmark")
    rows = decontam.find(spark.read.parquet(f"{SF_SMALL}/documents.parquet"),
                         spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).toPandas()
    got = set(zip(rows.doc_id, rows.item_id))
    small = {i: set(shingles(words(t))) for i, t in zip(items.item_id, items.text)}
    want = set()
    for d, t in zip(docs.doc_id, docs.text):
        own = set(shingles(words(t)))
        for i, item in zip(items.item_id, items.text):
            if own & small[i] and slow_matches(t, item):
                want.add((d, i))
    assert got == want and got


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen " \
       "sixteen seventeen eighteen nineteen twenty alpha beta gamma delta epsilon zeta eta theta iota kappa"


def test_planted_passages(spark):
    w = ITEM.split()
    filler = " ".join(f"filler{i}" for i in range(300))
    texts = [(1, ITEM), (2, f"{filler} {ITEM.upper()}!! {filler}"), (3, f"{filler} {' '.join(w[:-2])} {filler}"),
             (4, f"{filler} {' '.join(w[:12])} {filler}"), (5, filler), (6, f"{ITEM} {filler} {ITEM}"),
             (7, ", ".join(w)), (8, " ".join(["x", *w[1:]]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM), (11, ITEM), (12, "too short"), (13, None), (14, "")],
                                  "item_id long, text string")
    rows = decontam.find(docs, bench).toPandas()
    found = rows[rows.item_id == 10].groupby("doc_id").size().to_dict()
    assert found == {1: 1, 2: 1, 3: 1, 6: 2, 7: 1, 8: 1}
    assert set(rows.item_id) == {10, 11}
    flag = decontam.is_clean(docs, bench)(docs["text"])
    assert sorted(r[0] for r in docs.where(flag).collect()) == [4, 5]


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(2)
    index = decontam.Index([(i, " ".join(f"w{rng.integers(40)}" for _ in range(20))) for i in range(120)])
    for base in index.prints[:40].tolist():
        probe = base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False))
        want = np.flatnonzero(np.bitwise_count(index.prints ^ np.uint64(probe)) <= decontam.RADIUS)
        assert index.within(probe).tolist() == want.tolist()


def test_benchmark_in_parts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    whole = sorted(map(tuple, decontam.find(docs, bench).collect()))
    monkeypatch.setattr(decontam, "PART_WORDS", 300)
    assert len(list(decontam.parts(bench))) > 1
    assert sorted(map(tuple, decontam.find(docs, bench).collect())) == whole


def test_odd_rows(spark):
    docs = odd_documents(spark, [("item_id", 1), ("similarity", "x")])
    bench = spark.createDataFrame([(1, "the same words of one text here again")], "item_id long, text string")
    rows = decontam.find(docs, bench).toPandas()
    assert sorted(rows.doc_id) == [5, 5, 6] and (rows.similarity == 1).all()
    assert decontam.find(empty(spark), bench).count() == 0
    assert decontam.find(docs, bench.where("item_id < 0")).count() == 0


def test_swapped_halves(spark):
    rng = np.random.default_rng(4)
    filler = [f"filler{i}" for i in range(300)]
    rows, items = [], []
    for i, n in enumerate((100, 100, 60, 200)):
        w = [f"w{x}" for x in rng.integers(0, 50_000, n)]
        items.append((i, " ".join(w)))
        for k in (n // 2, n // 3):
            rows.append((10 * i + len(rows) % 2, " ".join([*filler, *w[k:], *w[:k], *filler])))
    want = {(d, i) for d, t in rows for i, item in items if slow_matches(t, item)}
    assert len(want) == len(rows)
    got = decontam.find(spark.createDataFrame(rows, "doc_id long, text string"),
                        spark.createDataFrame(items, "item_id long, text string")).toPandas()
    assert set(zip(got.doc_id, got.item_id)) == want


def test_best_window_of_random_edits_equals_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(150):
        n = int(rng.integers(6, 80))
        w = [f"w{x}" for x in rng.integers(0, 400, n)]
        item = " ".join(w)
        k = int(rng.integers(0, n))
        made = [w[k:] + w[:k], w[:k] + ["new"] * 2 + w[k:], w[:k] + w[k + 3:], w[k // 8:]][rng.integers(4)]
        around = [f"f{x}" for x in rng.integers(0, 30, 40)]
        text = " ".join([*around[:rng.integers(0, 40)], *made, *around[:rng.integers(0, 40)]])
        index = decontam.Index([(1, item)])
        got = index.matches(decontam.shingles(decontam.WordHash().of(text)))
        t, s, size = words(text), shingles(words(item)), n - 4
        at = len(t) - 4
        spans = {(max(a, 0), min(a + size, at)) for a in range(1 - size, at)}
        best = 0.0
        for a, b in spans:
            own = shingles(t[a:b + 4])
            both = sum((s & own).values())
            best = max(best, both / (sum(s.values()) + sum(own.values()) - both))
        assert max([m[3] for m in got], default=0.0) == (best if best >= 0.8 else 0.0)
