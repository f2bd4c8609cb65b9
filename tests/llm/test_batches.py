from pyspark.sql import functions as F

from tidemark.llm.common import in_batches


def test_no_id_is_hot(spark):
    """Rows of one id, and rows without one, are spread over the batches by their texts."""
    text = F.concat(F.repeat(F.lit("word "), 20), F.col("id").cast("string"))
    for doc_id in (F.lit(7), F.lit(None)):
        docs = spark.range(20_000).select(doc_id.cast("long").alias("id"), text.alias("text"))
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
        batches = in_batches(docs, ["id", "text"], size, size // 40).groupBy("batch").agg(F.sum(F.octet_length("text")).alias("b"))
        assert batches.agg(F.max("b")).first()[0] < 1.5 * size / 40
