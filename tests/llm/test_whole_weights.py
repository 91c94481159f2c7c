"""A text that is posted often weighs as much as one that is posted once."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.llm.mixing import mix


def test_weight_of_many_copies(spark):
    posts = 100_000
    docs = spark.range(2 * posts).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).alias("n"), F.when(F.col("id") < posts, F.lit(posts)).otherwise(F.lit(1)).alias("posts"))
    targets = spark.createDataFrame([("a", 1.0, 4)], "source string, target_share double, max_repeats int")
    got = mix(docs, targets, "doc_id", "source", "n", 1 / F.col("posts"), total=10.0 * posts / 2)
    copies = got.groupBy((F.col("doc_id") < posts).alias("posted")).agg(F.sum("copies").alias("n")).collect()
    by = {r["posted"]: r["n"] for r in copies}
    # The copies hold 1 of 100,001 of the weight: half a document is expected of them, and 50 were it 1/1000 each.
    assert abs(by[False] - posts / 2) <= 10 and by.get(True, 0) <= 10
