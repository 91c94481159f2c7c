"""p6: the documents in containers of each kind, by their size in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.packing import pack, unused_room
from cadenza.llm.tokens import count_tokens
from cadenza.sources.tables import table


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    # One row per kind of container: a parameter, four rows.
    kinds = {r["container_kind"]: r["capacity_tokens"] for r in table(spark, folder, "pack_capacity").collect()}
    return pack(table(spark, folder, "documents"), "doc_id", count_tokens("text"), kinds)


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every container with what is in it and the room that is left."""
    return unused_room(p6_pack(spark, folder))


def p6_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of a packing, per kind: documents that are not there, tokens lost or doubled, containers with
    more than they hold, documents divided without need."""
    documents = table(spark, folder, "documents").select("doc_id", count_tokens("text").alias("n"))
    packed = p6_pack(spark, folder)
    got = packed.groupBy("container_kind", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("parts"))
    kinds = table(spark, folder, "pack_capacity").select("container_kind")
    wanted = documents.join(F.broadcast(kinds), how="cross")  # four kinds: a parameter
    each = wanted.join(got, ["container_kind", "doc_id"], "left").groupBy("container_kind").agg(
        F.count_if(F.col("got").isNull()).alias("n_missing"), F.count_if(F.col("got") != F.col("n")).alias("n_wrong_size"), F.count_if((F.col("parts") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("n_divided")
    )
    over = unused_room(packed).groupBy("container_kind").agg(F.count_if(F.col("unused_tokens") < 0).alias("n_overfull"))
    return each.join(over, "container_kind")


QUERIES = {"p6_pack": p6_pack, "p6_containers": p6_containers, "p6_invariants": p6_invariants}
ORACLES = {"p6_invariants": "SELECT container_kind, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_wrong_size, CAST(0 AS BIGINT) AS n_divided, CAST(0 AS BIGINT) AS n_overfull FROM pack_capacity"}
