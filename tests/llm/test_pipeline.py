import os
import random
import shutil
import subprocess
import sys

import corpus_pipeline
from laborlens.llm import decontam, langid, packing, simhash
from laborlens.llm.common import materialise
from tests.conftest import SF_SMALL
from tests.llm.helpers import empty, odd_documents


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, before = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF_SMALL), name)
        assert out.columns == columns
        seen[name] = docs, out
        after = {r[0] for r in out.select("doc_id").collect()}
        assert after <= before
        docs, before = out, after
    given, kept = seen["near_duplicates"]
    classes = {r.component_id for r in simhash.near_duplicates(given).collect()}
    assert {r.doc_id for r in kept.collect()} == classes
    given, kept = seen["decontamination"]
    hit = {r.doc_id for r in decontam.find(given, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).collect()}
    assert hit and {r.doc_id for r in kept.collect()} == {r.doc_id for r in given.collect()} - hit
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).toPandas()
    assert set(last.doc_id) == before
    assert (last.groupby("sequence_id").length.sum() <= packing.CAPACITY).all()
    assert sum(1 for _ in corpus_pipeline.run(spark, SF_SMALL).toLocalIterator()) == len(last)


def test_odd_documents(spark):
    docs = odd_documents(spark, [("quality_score", 1), ("component_id", 2)])
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF_SMALL), name)
        if name == "language":
            assert out.where("text IS NULL OR trim(text) = ''").count() == 0
        if name == "near_duplicates":
            assert sorted(r[0] for r in out.where("doc_id IS NOT NULL").select("doc_id").collect()) == [1, 4, 5, 7, 8]
            assert out.where("doc_id IS NULL").count() == 1
        if name != "packing":
            assert out.columns == docs.columns
        assert materialise(stage(spark, empty(spark), SF_SMALL), name).count() == 0


def test_rest_works_without_this_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q)"],
                          cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert said.returncode == 0, said.stderr[-800:]
    assert said.stdout.split()[1] == "False"


def test_unknown_language_goes(spark):
    docs = spark.createDataFrame([(1, "12345 !!!"), (2, "the words of the text and the other words")],
                                 "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    out = corpus_pipeline.keep_language(spark, docs.union(docs.selectExpr("doc_id + 10", "text", "lang", "source", "n_chars")), SF_SMALL)
    assert langid.UNKNOWN == "und" and {r.doc_id % 10 for r in out.collect()} == {2}


def test_repeated_ids_with_other_texts_stay(spark):
    rng = random.Random(1)
    a, b, c, d, e = (" ".join(f"{x}{rng.randrange(9999)}" for _ in range(80)) for x in "abcde")
    rows = [(5, a), (5, b), (5, b), (3, a), (9, b), (5, c), (7, d), (7, d), (8, d), (None, a), (None, e), (None, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF_SMALL).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, e), (3, a), (5, b), (5, c), (7, d)])


def test_one_row_of_an_id_with_near_duplicates(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(400))
    docs = spark.createDataFrame([(1, long), (1, long + " e0"), (2, long)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF_SMALL).collect()
    assert [r.doc_id for r in kept] == [1]
    assert simhash.near_duplicates(docs).select("fingerprint").distinct().count() == 2


def test_workers_get_small_batches(spark):
    """A stage's texts go to the workers in batches of at most BATCH_ROWS rows; a smaller size that is set stays."""
    at = corpus_pipeline.ARROW_ROWS
    docs, rows = odd_documents(spark, []), spark.range(0, 1200, 1, 1)

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    try:
        for given, most in ((10_000, corpus_pipeline.BATCH_ROWS), (100, 100)):
            spark.conf.set(at, str(given))
            dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, SF_SMALL)
            n = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
            assert sum(n) == 1200 and max(n) == most
    finally:
        spark.conf.unset(at)


def test_a_worker_keeps_one_large_value():
    """A tokenizer with its cache goes when another operator's large value comes, or when a stage frees the worker."""
    from laborlens.llm import common
    made = []

    def make(name):
        return lambda: made.append(name) or name

    assert common.worker_cache("small_t", make("small")) == "small"
    assert [common.worker_cache("one_t", make("one"), large=True) for _ in range(2)] == ["one", "one"]
    assert common.worker_cache("two_t", make("two"), large=True) == "two"
    assert common.worker_cache("one_t", make("again"), large=True) == "again"
    common.free_worker()
    assert common.worker_cache("one_t", make("third"), large=True) == "third"
    assert common.worker_cache("small_t", make("small")) == "small"
    assert made == ["small", "one", "two", "again", "third"]


def test_quality_frees_the_packing_tokenizer(spark):
    """After packing, the worker that counts the quality stage's contexts no longer holds the tokenizer."""
    import pyarrow as pa
    from laborlens.llm import packing, quality

    def held(batches):
        import sys
        yield from (b for b in batches if False)
        store = vars(sys.modules.get("_laborlens_worker", object())) if "_laborlens_worker" in sys.modules else {}
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(k.startswith("ids_") for k in store)], pa.int64())})

    docs = spark.createDataFrame([(k, f"word{k} of text") for k in range(32)], "doc_id long, text string").repartition(16)

    def workers():
        return sum(r["n"] for r in docs.mapInArrow(held, "n long").collect())

    packing.tokenise(docs).count()
    assert workers() > 0
    for _ in range(6):                                   # all workers get some of these tasks
        quality.context_table(docs)
    assert workers() == 0
