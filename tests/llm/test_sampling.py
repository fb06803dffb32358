"""Samples are the same whether the hash was cut first or not."""

from pyspark.sql import functions as F

from treeline.llm.sampling import labelled_sample


def test_the_cut_changes_nothing(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    for every in (1, 50):  # with few labels, the cut leaves too few and all are gone through
        labels = docs.where(F.col("doc_id") % every == 0).select("doc_id", (F.col("doc_id") % 2).alias("y"))
        whole = labelled_sample(docs, labels, "y", 40, 100, 1)
        assert len(whole) == 40 and labelled_sample(docs, labels, "y", 40, 100, 3000) == whole
