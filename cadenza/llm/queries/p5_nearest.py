"""p5: the chunk of each model that starts nearest to a slot's start or answer time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.nearest import nearest_in_time
from cadenza.sources.tables import table

TOLERANCE_S = 2.0


def p5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    slots = table(spark, folder, "slots").select(
        "sample_id",
        "slot_id",
        # least() passes over a missing end; a missing start leaves the anchor out.
        F.explode(F.array(F.struct(F.lit("start").alias("anchor"), F.when(F.col("start").isNotNull(), F.least("start", "end")).alias("at")), F.struct(F.lit("t_a").alias("anchor"), F.col("t_a").alias("at")))).alias("x"),
    )
    chunks = table(spark, folder, "chunks")
    first = F.when(F.col("start").isNotNull(), F.least("start", "end"))
    found = nearest_in_time(
        slots,
        chunks,
        "sample_id",
        (F.col("x.anchor"), F.col("slot_id"), F.col("x.at")),
        (F.col("model_name"), F.col("chunk_id"), first),
        TOLERANCE_S,
    )
    return found.select(
        F.col("query_label").alias("anchor"),
        F.col("label").alias("model_name"),
        "sample_id",
        F.col("query_id").cast("int").alias("slot_id"),
        F.col("id").alias("chunk_id"),
        F.col("delta").alias("delta_ms"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_nearest(spark, folder).drop("delta_ms")


P5_SQL = """
WITH a AS (
  SELECT DISTINCT 'start' AS anchor, sample_id, slot_id, CAST(round(coalesce(least(start, "end"), start) * 1000) AS BIGINT) AS t
  FROM slots WHERE start IS NOT NULL
  UNION SELECT DISTINCT 't_a', sample_id, slot_id, CAST(round(t_a * 1000) AS BIGINT) FROM slots WHERE t_a IS NOT NULL),
c AS (
  SELECT model_name, sample_id, CAST(round(coalesce(least(start, "end"), start) * 1000) AS BIGINT) AS t, min(chunk_id) AS chunk_id
  FROM chunks WHERE start IS NOT NULL GROUP BY ALL),
j AS (
  SELECT anchor, model_name, a.sample_id, slot_id, chunk_id, c.t - a.t AS delta_ms,
    row_number() OVER (PARTITION BY anchor, model_name, a.sample_id, slot_id ORDER BY abs(c.t - a.t), chunk_id) AS rn
  FROM a JOIN c ON a.sample_id = c.sample_id AND c.t BETWEEN a.t - 2000 AND a.t + 2000)
SELECT anchor, model_name, sample_id, slot_id, chunk_id{more} FROM j WHERE rn = 1
"""

QUERIES = {"p5_found": p5_found, "p5_nearest": p5_nearest}
ORACLES = {"p5_found": P5_SQL.format(more=""), "p5_nearest": P5_SQL.format(more=", delta_ms")}
