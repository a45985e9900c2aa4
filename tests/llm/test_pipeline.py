import importlib.util

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_stages_apply_in_order(spark):
    docs = first = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == first.columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    counts = []
    for table in (odd, none):
        docs, n = table, []
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
            n.append(docs.count())
            assert name == "pack" or docs.columns == table.columns
        counts.append(n)
    assert counts[1] == [0] * 5
    first, exact, near, mixed, packed = counts[0]
    assert odd.count() >= first >= exact >= near > 0 and mixed > 0 and packed >= mixed
    texts = [(r.text or "").lower() for r in corpus_pipeline.STAGES[1][1](spark, odd, DATA).collect()]
    assert len(texts) == len(set(texts)) == len({(r.text or "").lower() for r in odd.collect()})
