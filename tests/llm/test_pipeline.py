from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import SF


def test_stages_take_effect_and_keep_clean_documents(spark, documents):
    docs = documents.unionByName(documents.where("doc_id = 3").withColumn("doc_id", F.lit(900).cast("long"))).unionByName(documents.limit(1).withColumn("doc_id", F.lit(901).cast("long")).withColumn("text", F.lit("12 34")))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = docs.unionByName(documents.limit(1).withColumn("doc_id", F.lit(902).cast("long")).withColumn("text", F.concat(F.lit("some words before "), F.lit(item)))).persist()
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == documents.columns
        after = after.persist()
        gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in after.select("doc_id").collect()}
        ids[name] = gone
        docs = after
    assert ids["language"] == {901} and 3 in ids["exact"] and 902 in ids["benchmark_free"]
    packed = corpus_pipeline.packed(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
