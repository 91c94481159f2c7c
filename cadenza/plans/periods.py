"""p3: continuous periods and gaps of the chunks and of the slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.periods import periods_and_gaps
from cadenza.plans import Query
from cadenza.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select(F.lit("chunks").alias("track"), "model_name", "sample_id", "start", "end")
    slots = table(spark, folder, "slots").select(F.lit("slots").alias("track"), F.lit("").alias("model_name"), "sample_id", "start", "end")
    # Rows delivered twice are equal intervals and add nothing to a union of intervals.
    return periods_and_gaps(chunks.unionByName(slots), ["track", "model_name", "sample_id"])


P3_SQL = """
WITH raw AS (
  SELECT 'chunks' AS track, model_name, sample_id, start AS a, "end" AS b FROM chunks
  UNION ALL SELECT 'slots', '', sample_id, start, "end" FROM slots),
iv AS (
  SELECT DISTINCT track, model_name, sample_id,
    CAST(round(least(a, b) * 1000) AS BIGINT) AS s, CAST(round(greatest(a, b) * 1000) AS BIGINT) AS e
  FROM raw WHERE a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b)),
prev AS (
  SELECT *, max(e) OVER (PARTITION BY track, model_name, sample_id ORDER BY s, e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM iv),
isl AS (
  SELECT *, sum(CASE WHEN top IS NULL OR s > top + 250 THEN 1 ELSE 0 END)
    OVER (PARTITION BY track, model_name, sample_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM prev),
per AS (SELECT track, model_name, sample_id, g, min(s) AS s, max(e) AS e FROM isl GROUP BY ALL),
nxt AS (SELECT *, lead(s) OVER (PARTITION BY track, model_name, sample_id ORDER BY s) AS ns FROM per)
SELECT track, model_name, sample_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM per
UNION ALL
SELECT track, model_name, sample_id, 'gap', e, ns FROM nxt WHERE ns - e > 250 AND ns - e <= 900000
"""

QUERIES: dict[str, Query] = {"p3_found": p3_found}
ORACLES = {"p3_found": P3_SQL}
