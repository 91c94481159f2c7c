"""p2: broken pairs among annotated answers and models' answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.pairs import broken_pairs
from cadenza.sources.tables import once


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    slots = once(spark, folder, "slots", ["sample_id", "slot_id", "question_text", "gt_answer", "is_interrupted"], near=["sample_id", "slot_id"])
    annotated = slots.select(F.lit("slots").alias("pair_table"), F.col("slot_uid").alias("pair_id"), F.col("question_text").alias("question"), F.col("gt_answer").alias("answer"), F.lit(False).alias("interrupted"))
    spoken = once(spark, folder, "unified_eval", ["sample_id", "slot_id", "actual_text"], near=["sample_id", "slot_id"])
    asked = slots.select("sample_id", "slot_id", F.col("question_text").alias("question"), F.col("is_interrupted").alias("interrupted"))
    spoken = spoken.join(asked, ["sample_id", "slot_id"]).select(F.lit("unified_eval").alias("pair_table"), F.col("eval_id").alias("pair_id"), "question", F.col("actual_text").alias("answer"), "interrupted")
    return annotated.unionByName(spoken)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return broken_pairs(_pairs(spark, folder))


QUERIES = {"p2_found": p2_found}
ORACLES: dict[str, str] = {}
