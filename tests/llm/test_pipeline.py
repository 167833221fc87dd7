import gc

import corpus_pipeline
from sylva.llm import ngram_join, queries
from sylva.llm.common import documents, written

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_join", "mixing", "bpe"]
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 11))


def test_stages(spark):
    docs = documents(spark, SMALL)
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert out.count() == sizes[4]
    assert out.where("n_tokens = 0").count() == 0


def test_near_copies_are_gone(spark):
    docs = corpus_pipeline.near_duplicates(spark, documents(spark, SMALL), SMALL)
    linked = ngram_join.linked(docs, 5, 80).where("component IS NOT NULL")
    assert linked.groupBy("component").count().where("count > 1").count() == 0


def test_empty(spark):
    docs = documents(spark, SMALL).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), "empty")
        assert docs.count() == 0


def test_bpe_begins_with_small_heaps(spark):
    """What earlier stages have left in the executors' heaps is given back to the system before Python workers need it."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    garbage = [spark.sparkContext._gateway.new_array(spark._jvm.byte, 100 << 20) for _ in range(4)]
    full = heap.totalMemory()
    del garbage
    gc.collect()
    corpus_pipeline.bpe(spark, documents(spark, SMALL), SMALL)
    assert heap.totalMemory() < full
