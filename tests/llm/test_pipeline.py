"""The pipeline's stages on whole small tables."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_follow_each_other(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids
        ids = kept
    tokens = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    packed = corpus_pipeline.run(spark, folder)
    assert packed.agg(F.sum("length")).first()[0] == tokens
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
