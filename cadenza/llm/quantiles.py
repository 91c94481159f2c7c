"""Percentiles with bounded rank error from mergeable sketches.

The sketch is the KLL one: a hierarchy of randomized compactors, each of which sorts its buffer and
passes every other value up with doubled weight; two sketches merge level by level. Spark carries it
as an aggregate function of the JVM, with a map-side part, so a hot group costs one sketch per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Compactor size. The rank error falls almost as 1/k, the sketch grows with k (about 3k values).
K = 2048

#: Fixed values of the published error formula of the sketch: error = A / k ** B, at 99 % confidence.
ERROR_A, ERROR_B = 2.296, 0.9021


def rank_error(k: int = K) -> float:
    """Bound on |rank of the answer - asked rank| as a share of n, for one query, at 99 % confidence.

    Up to k values a sketch holds every one of them and the answer is exact.
    """
    return ERROR_A / k**ERROR_B


def partial_sketches(df: DataFrame, keys: list[str], value: str | Column, part: dict[str, Column], k: int = K) -> DataFrame:
    """One sketch per group and part (a day, a delivery): keys, the part's columns, sketch.

    NULL and NaN are left out; infinities take part; a group without values gives no row; NULL keys
    form a group of their own; repeated rows count as often as they occur; an empty table gives none.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, *[c.alias(n) for n, c in part.items()], v.cast("double").alias("__v"))
    rows = rows.filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    return rows.groupBy(*keys, *part).agg(F.kll_sketch_agg_double("__v", F.lit(k)).alias("sketch"))


def combine(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Sketches of the same group merged, whatever parts they come from: keys, sketch, n_parts."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n_parts"))


def read_percentiles(sketches: DataFrame, keys: list[str], percents: list[float], k: int = K) -> DataFrame:
    """keys, n_values, a column p<percent> for each percent, and the bound on the rank error."""
    answers = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p) / 100)).alias(f"p{p:g}".replace(".", "_")) for p in percents]
    kept = [c for c in sketches.columns if c not in (*keys, "sketch")]
    return sketches.select(*keys, *kept, F.kll_sketch_get_n_double("sketch").alias("n_values"), *answers, F.lit(rank_error(k)).alias("rank_error"))
