"""The stages of the pipeline on the small tables, against what a plain reading of each stage gives."""

import hashlib

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, kept = kept, stage(spark, kept, SF)
        kept = spark.createDataFrame(kept.toPandas(), kept.schema)
        if k < 4:
            assert kept.columns == columns, name
    quality, lines, near, mixed = [stage for _, stage in corpus_pipeline.STAGES[:4]]
    judged = quality(spark, docs, SF)
    words = lambda t: len((t or "").encode().split())
    assert all(words(r.text) >= 6 for r in judged.collect())
    one = near(spark, docs, SF).collect()
    texts = {r.text for r in one}
    assert len(texts) == len(one)  # exact copies are gone
    many = mixed(spark, docs, SF)
    assert many.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    assert {r.decoded_sha256 for r in corpus_pipeline.encoding(spark, docs, SF).collect()} == {hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
