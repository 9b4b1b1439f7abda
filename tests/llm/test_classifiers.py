from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from laborlens.llm import langid, quality, queries, toxicity
from tests.llm.helpers import empty, odd_documents, pandas_table

SF = "/root/testdata/sf0.01"


def auc(y, score):
    rank = pd.Series(score).rank().to_numpy()
    one = int(np.sum(y))
    return (rank[y == 1].sum() - one * (one + 1) / 2) / (one * (len(y) - one))


@pytest.mark.parametrize("query,label,least", [(queries.op1, "quality", 0.9), (queries.op8, "toxic", 0.7)])
def test_held_out_accuracy(spark, query, label, least):
    rows = query(spark, SF).toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    cut = 0.3 if label == "quality" else 0.5
    assert (rows.predicted == (rows.score >= cut)).all()
    held = rows[rows.held_out].merge(pandas_table(SF, "labels"), on="doc_id")
    assert auc(held[label].to_numpy(), held.score.to_numpy()) > least


@pytest.mark.parametrize("module,pred", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_odd_rows(spark, module, pred):
    docs = odd_documents(spark, [("_y", 1), ("_text", "x")])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)] + [(4, None, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = module.classify(docs, labels).toPandas()
    assert len(rows) == 10 and rows[f"{pred}_score"].between(0, 1).all()
    blank = rows[rows.doc_id.isin([1, 2])]
    assert blank[f"{pred}_score"].nunique() == 1
    assert rows[rows.doc_id == 5][f"{pred}_score"].nunique() == 1
    # without labels, with one class, without documents
    none = module.classify(docs, labels.where("doc_id < 0")).toPandas()
    assert np.allclose(none[f"{pred}_score"], 0.5)
    one = module.classify(docs, labels.where("quality = 1")).toPandas()
    assert (one[f"{pred}_score"] > 0.99).all()
    assert module.classify(empty(spark), labels).count() == 0


def test_pooling_by_parts_is_the_same(monkeypatch):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(quality.SLOTS, quality.DIM)).astype(np.float32)
    text = " ".join(f"w{i % 37}" for i in range(500))
    whole = quality.pooled(text, vectors, quality.Slots())
    monkeypatch.setattr(quality, "GATHER", 64)
    assert np.allclose(whole, quality.pooled(text, vectors, quality.Slots()), atol=1e-4)


def test_context_table_equals_brute_force(spark):
    texts = ["a b c a", "b a", None, "", "c c c , !"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    plus, minus = quality._index_vectors()
    table = np.zeros((quality.SLOTS, quality.DIM))
    for t in texts:
        ids = quality.Slots().of(t).tolist()
        for i, x in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    table[x, plus[ids[j]]] += 1
                    table[x, minus[ids[j]]] -= 1
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    assert np.allclose(quality.context_table(docs), table / np.where(norm > 0, norm, 1), atol=1e-6)


# --- languages ---

def slow_grams(text):
    flat = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    words = flat.split()
    if not words:
        return Counter()
    flat = " " + " ".join(words) + " "
    found = Counter(c for c in flat if c != " ")
    found.update(flat[i:i + 2] for i in range(len(flat) - 1))
    found.update(flat[i:i + 3] for i in range(len(flat) - 2))
    return found


def code(gram):
    n = 0
    for c in gram:
        n = n << 21 | (0 if c == " " else ord(c))
    return n


def ranked(counts):
    merged = Counter()
    for g, n in counts.items():
        merged[code(g)] += n
    return [c for c, _ in sorted(merged.items(), key=lambda x: (-x[1], x[0]))[:langid.PROFILE]]


def test_language_equals_brute_force(spark):
    import zlib
    docs = pandas_table(SF, "documents", ["doc_id", "text", "lang"])
    by_lang: dict = {}
    for i, t, lang in zip(docs.doc_id, docs.text, docs.lang):
        if zlib.crc32(str(i).encode()) % 4 != 2:
            by_lang.setdefault(lang, Counter()).update(slow_grams(t))
    profile = {k: {c: r for r, c in enumerate(ranked(v))} for k, v in sorted(by_lang.items())}
    rows = queries.op7(spark, SF).toPandas().set_index("doc_id")
    for i, t in list(zip(docs.doc_id, docs.text))[:60]:
        mine = ranked(slow_grams(t))
        cost = {k: sum(abs(p[c] - r) if c in p else langid.PROFILE for r, c in enumerate(mine))
                for k, p in profile.items()}
        best = min(cost, key=cost.get)
        assert rows.lang_pred[i] == best
        assert rows.score[i] == pytest.approx(1 - cost[best] / (langid.PROFILE * len(mine)))
    held = rows[rows.held_out].join(docs.set_index("doc_id").lang)
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_language_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "SLICE", 1000)           # a long text in several slices
    docs = odd_documents(spark, [("lang_pred", "x"), ("score", 1)])
    rows = langid.identify(docs).select("doc_id", "langid.*").toPandas()
    assert len(rows) == 10 and rows.score.between(0, 1).all()
    blank = rows[rows.doc_id.isin([1, 2, 3])]
    assert (blank.lang_pred == "und").all() and (blank.score == 0).all()
    assert set(rows[rows.doc_id.isin([5, 6])].lang_pred) == {"en"}
    untaught = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r[0] for r in untaught.select("langid.lang_pred").collect()} == {"und"}
    assert langid.identify(empty(spark)).count() == 0


def test_long_text_counts_like_a_short_one(monkeypatch):
    text = "abc déf " * 300
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "SLICE", 101)
    parts = langid.ngram_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    slots = toxicity.slots(text)
    monkeypatch.setattr(toxicity, "SLICE", 101)
    assert (slots == toxicity.slots(text)).all()


def slow_slots(text):
    """Slots of a text's n-grams by plain Python integers."""
    flat, out = " " + " ".join(text.lower().split()) + " ", set()
    mult, top = 0x9E3779B97F4A7C15, (1 << 64) - 1
    for at in range(len(flat)):
        code = ord(flat[at]) + 1
        for k in range(1, toxicity.SIZES[-1]):
            if at + k >= len(flat):
                break
            code = (code * mult + ord(flat[at + k]) + 1) & top
            code ^= code >> 29
            if k + 1 in toxicity.SIZES:
                out.add((code * mult & top) >> 46)
    return out


TEXTS = [("you are a fool", 1), ("what a fool you were", 1), ("nice words here", 0), ("a nice day", 0), ("a fool's day", 1),
         ("more nice words of a day", 0), ("", 0), ("fool fool", 1), ("here we go on", 0)]


def labelled(spark, copies=4):
    rows = [(i * len(TEXTS) + k, t + f" {i}", y) for i in range(copies) for k, (t, y) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "_id long, _text string, _y int").repartition(3), rows


def test_ratios_equal_brute_force(spark):
    sample, rows = labelled(spark)
    n = np.ones((2, toxicity.SLOTS))
    for _, t, y in rows:
        assert set(toxicity.slots(t).tolist()) == slow_slots(t)
        n[y, list(slow_slots(t))] += 1
    want = np.log((n[1] / n[1].sum()) / (n[0] / n[0].sum()))
    assert np.allclose(toxicity.log_count_ratios(sample), want)


def test_fit_is_a_minimum_and_scores_equal_brute_force(spark):
    """No slot is left out; the gradient of the plain objective vanishes at the fitted weights."""
    sample, rows = labelled(spark)
    held = toxicity.features(sample.withColumn("_aside", F.lit(False)))
    ratio = toxicity.log_count_ratios(sample)
    value = toxicity.loss_and_gradient(held, ratio, len(rows), toxicity.L2)
    x = toxicity.minimised(value, np.zeros(toxicity.SLOTS + 1), 60)
    own = [sorted(slow_slots(t)) for _, t, _ in rows]
    y = np.asarray([r[2] for r in rows], float)
    z = np.asarray([(x[:-1] * ratio)[o].sum() + x[-1] for o in own])
    d = 1 / (1 + np.exp(-z)) - y
    slope = np.append(toxicity.L2 * x[:-1], d.mean())
    for o, e in zip(own, d):
        slope[o] += e * ratio[o] / len(rows)
    loss = (np.logaddexp(0, z) - y * z).mean() + toxicity.L2 / 2 * (x[:-1] ** 2).sum()
    got, gradient = value(x)
    assert got == pytest.approx(loss) and np.allclose(gradient, slope)
    assert np.linalg.norm(slope) < 0.02 * np.linalg.norm(value(np.zeros(len(x)))[1])
    found = toxicity.log_odds(held, x[:-1] * ratio, x[-1])
    assert sorted(found.z) == pytest.approx(sorted(z))


def test_calibration_has_the_least_log_loss():
    rng = np.random.default_rng(4)
    z = rng.normal(size=4000) * 3
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * z - 1)))).astype(float)
    scale, shift = toxicity.calibration(z, y)
    assert scale == pytest.approx(0.5, abs=0.05) and shift == pytest.approx(-1, abs=0.1)
    apart = toxicity.calibration(np.asarray([-9.0, -8, 8, 9]), np.asarray([0.0, 0, 1, 1]))
    assert np.isfinite(apart).all() and apart[0] > 0


def test_toxic_rows_of_the_held_out_fold(spark):
    """Accuracy with all slots, on rows the fit has not seen."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op8(spark, sf).toPandas()
    held = rows[rows.held_out].merge(pandas_table(sf, "labels"), on="doc_id")
    held = held[held.toxic.notna()]
    assert auc(held.toxic.to_numpy(), held.score.to_numpy()) >= 0.98
    assert (held[held.toxic == 1].predicted == 1).mean() >= 0.74
    assert (held[held.predicted == 1].toxic == 1).mean() >= 0.95
