"""p1: percentiles of the seconds spoken past a slot's end, per kind of scene and question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.scalars import clean_label
from cadenza.llm.quantiles import combine, partial_sketches, rank_error, read_percentiles
from cadenza.sources.tables import once

KEYS = ["scene_type", "question_type"]
PERCENTS = [50, 90, 95, 99]


def _values(spark: SparkSession, folder: str) -> DataFrame:
    rows = once(spark, folder, "unified_eval", ["scene_type", "question_type", "spill_seconds"])
    return rows.select(
        clean_label("scene_type").alias("scene_type"),
        clean_label("question_type", "unknown").alias("question_type"),
        "spill_seconds",
        F.to_date("evaluated_at").alias("day"),
    )


def p1_daily_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """The partial results that are kept: one sketch per day and group."""
    return partial_sketches(_values(spark, folder), KEYS, "spill_seconds", {"day": F.col("day")})


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """The percentiles over all days, from the days' sketches alone."""
    merged = combine(p1_daily_sketches(spark, folder), KEYS)
    return read_percentiles(merged, KEYS, PERCENTS).withColumnRenamed("n_parts", "n_days")


def p1_rank_check(spark: SparkSession, folder: str) -> DataFrame:
    """Each answer against its true rank among all values of its group."""
    values = _values(spark, folder).filter(F.col("spill_seconds").isNotNull() & ~F.isnan("spill_seconds"))
    answers = p1_percentiles(spark, folder).select(*KEYS, F.array(*[F.struct(F.lit(p).alias("percent"), F.col(f"p{p}").alias("answer")) for p in PERCENTS]).alias("answers"))
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"a.{k}")) for k in KEYS]
    ranks = (
        values.alias("v").join(answers.alias("a"), same)
        .select(*[f"v.{k}" for k in KEYS], "spill_seconds", F.explode("answers").alias("x"))
        .groupBy(*KEYS, "x.percent")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("spill_seconds") < F.col("x.answer")).alias("below"), F.count_if(F.col("spill_seconds") <= F.col("x.answer")).alias("upto"))
    )
    # An answer is right if its own ranks, from the first to the last equal value, meet the bound; one rank of play for small groups.
    q, e = F.col("percent") / 100, F.lit(rank_error()) + 1 / F.col("n")
    return ranks.select(*KEYS, "percent", F.col("n").alias("n_values"), ((F.col("below") / F.col("n") - e <= q) & (F.col("upto") / F.col("n") + e >= q)).alias("within_bound"))


P1_CHECK_SQL = r"""
WITH once AS (
  SELECT DISTINCT eval_id, scene_type, question_type, spill_seconds FROM unified_eval
  WHERE spill_seconds IS NOT NULL AND NOT isnan(spill_seconds)),
g AS (
  SELECT nullif(lower(regexp_replace(scene_type, '^\s+|\s+$', '', 'g')), '') AS scene_type,
    coalesce(nullif(lower(regexp_replace(question_type, '^\s+|\s+$', '', 'g')), ''), 'unknown') AS question_type,
    count(*) AS n FROM once GROUP BY ALL)
SELECT scene_type, question_type, CAST(p AS INTEGER) AS percent, n AS n_values, true AS within_bound
FROM g, (VALUES (50), (90), (95), (99)) AS t(p)
"""

QUERIES = {"p1_percentiles": p1_percentiles, "p1_daily_sketches": p1_daily_sketches, "p1_rank_check": p1_rank_check}
ORACLES = {"p1_rank_check": P1_CHECK_SQL}
