"""p7: a mix of the documents in which each source has its target share of the tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.mixing import mix, shares
from cadenza.llm.tokens import count_tokens
from cadenza.session import cut_lineage
from cadenza.sources.tables import table


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix with their number of copies.

    A text that was posted n times in a source has 1/n of the weight in each of its documents, so that
    reposting a text does not give it a larger part of the mix.
    """
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    # Texts are read once; what follows works on their sizes and hashes.
    sized = cut_lineage(documents.select("doc_id", "source", count_tokens("text").alias("n_tokens"), F.xxhash64("text").alias("h"), F.length("text").alias("n")))
    posted = sized.groupBy("source", "h", "n").agg(F.count(F.lit(1)).alias("posts"))
    weighted = sized.join(posted, ["source", "h", "n"])
    out = mix(weighted, table(spark, folder, "mix_target"), "doc_id", "source", "n_tokens", 1 / F.col("posts"))
    return out.withColumnRenamed("size", "n_tokens")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares the mix reaches against those asked for."""
    mixed = p7_mix(spark, folder).withColumnRenamed("n_tokens", "size")
    return shares(mixed, table(spark, folder, "mix_target"), "source").withColumnRenamed("size", "n_tokens")


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of a mix, per source of the targets: no document more often than it may be, none of another
    source, and a size off its share by less than one typical document or 1 % of it."""
    targets = table(spark, folder, "mix_target")
    mixed = p7_mix(spark, folder)
    source = table(spark, folder, "documents").select("doc_id", F.col("source").alias("own"))
    right = mixed.join(source, "doc_id").groupBy("source").agg(F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("n_foreign"), F.max("n_tokens").alias("largest"))
    reached = shares(mixed.withColumnRenamed("n_tokens", "size"), targets, "source")
    total = F.sum("size").over(Window.partitionBy())  # a row per target
    off = F.abs(F.col("size") - F.col("reachable_share") * F.col("total"))
    rows = reached.withColumn("total", total).join(right, "source", "left")
    near = off <= F.greatest(0.01 * F.col("reachable_share") * F.col("total"), F.coalesce(F.col("largest"), F.lit(0)))
    return rows.select("source", (F.coalesce("most_copies", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), F.coalesce("n_foreign", F.lit(0)).alias("n_foreign"), near.alias("near_share"))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares, "p7_invariants": p7_invariants}
ORACLES = {"p7_invariants": "SELECT source, true AS within_cap, CAST(0 AS BIGINT) AS n_foreign, true AS near_share FROM mix_target"}
