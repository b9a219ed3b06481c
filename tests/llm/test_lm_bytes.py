"""What comes back to the blocks of the language model."""

from pyspark.sql import functions as F

from panelspark.llm import lm


def test_totals_come_back_without_hashes(spark):
    docs = spark.range(200).select(
        F.col("id").alias("doc_id"),
        F.expr("array_join(transform(sequence(1, 50), i -> concat('w', (id * i * 7) % 90)), ' ')").alias("text"),
    )
    some = lm.blocks(docs).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    sent = lm.pairs(some, 3)
    back = lm.arcs_of(sent).where("block IS NOT NULL")
    packed = [F.length(c) for c, kind in back.dtypes if kind == "binary"]
    pairs = sent.agg(F.sum(F.length("pairs"))).first()[0] / 8
    assert 0 < back.agg(F.sum(sum(packed, F.lit(0)))).first()[0] < 8 * pairs
