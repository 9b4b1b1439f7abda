import re

import numpy as np
import pytest
import xxhash

from laborlens.llm import simhash
from laborlens.llm.components import components
from tests.conftest import SF_SMALL
from tests.llm.helpers import empty, odd_documents, pandas_table


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(ids, prints, bits=3):
    prints = np.asarray(prints, np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits
    own = np.asarray(ids)
    while True:
        new = np.asarray([own[n].min() for n in near])
        if (new == own).all():
            return own
        own = new


def test_documents_equal_brute_force(spark):
    docs = pandas_table(SF_SMALL, "documents", ["doc_id", "text"]).set_index("doc_id").text
    rows = simhash.near_duplicates(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).toPandas()
    prints = [int(x, 16) for x in rows.fingerprint]
    assert prints == [slow_fingerprint(docs[i]) for i in rows.doc_id]
    assert (slow_classes(rows.doc_id, prints) == rows.component_id.to_numpy()).all()


@pytest.mark.parametrize("chunk", [4, 100_000])
def test_links_of_close_groups(spark, monkeypatch, chunk):
    """Groups of near fingerprints, with keys above and below the size that is cut."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    prints = set()
    for centre in rng.integers(0, 1 << 62, 12).tolist():
        for _ in range(25):
            prints.add(centre ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))))
    prints = [int(np.uint64(p).astype(np.int64)) for p in prints]
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r[0]: r[1] for r in components(simhash.links(frame)).collect()}
    got = [roots.get(p, p) for p in prints]
    want = slow_classes(prints, np.asarray(prints, np.int64).view(np.uint64))
    assert got == want.tolist()


def table_of(fps):
    far = np.bitwise_count(fps[:, None] ^ simhash.PIVOTS[None, :]).astype(np.uint8)
    return simhash.distances(list(np.ascontiguousarray(far).view("<i8").T))


def test_pivot_bound_never_discards_a_pair():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400, dtype=np.int64).view(np.uint64)
    flips = np.asarray([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in a], np.uint64)
    both = np.concatenate([a, a ^ flips])
    found = {tuple(sorted(p)) for i, j in simhash.close_pairs(both, table_of(both)) for p in zip(i.tolist(), j.tolist())}
    assert {(i, i + 400) for i in range(400)} <= found


def test_pivots_discard_candidates_before_any_bit_is_compared(spark):
    """Of the pairs that share a key, most of those too far apart go by the table alone; none that is close."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    near = base ^ np.asarray([1 << int(b) for b in rng.integers(0, 62, 300)], np.int64)
    first26 = base ^ (rng.integers(0, 1 << 37, 300, dtype=np.int64) << 26)          # the low bits alike
    fps = np.concatenate([base, near, first26])
    frame = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    keys = simhash.blocked_keys(frame).toPandas()
    table = simhash.distances([keys[c] for c in simhash.TABLE])
    want = np.bitwise_count(keys["fp"].to_numpy().view(np.uint64)[:, None] ^ simhash.PIVOTS[None, :])
    assert (table == want).all()
    gone = kept = 0
    for rows in keys.groupby(["choice", "key"]).indices.values():
        for i, j in zip(rows, rows[1:]):
            bits = bin((int(keys.fp[i]) ^ int(keys.fp[j])) & (1 << 64) - 1).count("1")
            ok = bool(simhash.may_be_close(table[[i]], table[[j]], simhash.MAX_BITS)[0])
            assert ok or bits > simhash.MAX_BITS
            if bits > simhash.MAX_BITS:
                gone, kept = gone + (not ok), kept + ok
    assert gone > 9 * kept > -1 and gone > 250


def test_odd_rows(spark):
    rows = simhash.near_duplicates(odd_documents(spark, [("fp", 1), ("component_id", 2)])).toPandas()
    assert len(rows) == 10
    blank = rows[rows.doc_id.isin([1, 2, 3])]
    assert (blank.fingerprint == "0" * 16).all() and (blank.component_id == 1).all()
    same = rows[rows.doc_id.isin([5, 6])]
    assert len(same) == 3 and (same.component_id == 5).all()
    assert rows[rows.doc_id.isna()].component_id.isna().all()
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    roots = {r[0]: r[1] for r in components(links).collect()}
    assert all(roots[i] == 0 for i in range(301)) and roots[1001] == 1000
