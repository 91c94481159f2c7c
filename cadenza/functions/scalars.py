"""Column helpers shared by the operators; all of them stay in generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_double(x: float) -> Column:
    return F.lit(float(x))


def safe_ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """numerator / denominator, and 0.0 where the denominator is NULL, zero or negative."""
    n, d = col(numerator).cast("double"), col(denominator).cast("double")
    return F.when(d > 0, n / F.when(d > 0, d)).otherwise(F.lit(0.0))


def f1(tp: ColumnLike, fp: ColumnLike, fn: ColumnLike) -> Column:
    """F1 from soft counts: the harmonic mean of precision and recall, 0.0 where both are 0."""
    p = safe_ratio(tp, col(tp) + col(fp))
    r = safe_ratio(tp, col(tp) + col(fn))
    return safe_ratio(2 * p * r, p + r)


def clamp(x: ColumnLike, low: float = 0.0, high: float = 1.0) -> Column:
    """x limited to [low, high]; NULL stays NULL, which greatest and least alone would lose."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(lit_double(low), F.least(lit_double(high), x)))


def strip(x: ColumnLike) -> Column:
    """Trim any Unicode white space, not just the plain spaces that trim() removes."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def clean_label(x: ColumnLike, default: str | None = None) -> Column:
    """Trimmed, in lower case; blank becomes NULL, or ``default`` where one is given."""
    s = F.lower(strip(x))
    s = F.when(s != "", s)
    return s if default is None else F.coalesce(s, F.lit(default))


def to_bool(x: ColumnLike) -> Column:
    """Loose truth: 1, true, yes, y and t in any case are true, all else is false."""
    return F.coalesce(F.lower(strip(col(x).cast("string"))).isin("1", "true", "yes", "y", "t"), F.lit(False))


def parse_time(x: ColumnLike) -> Column:
    """Seconds from "90", "1:02" or "1:00:05"; NULL where the text is none of these."""
    s = strip(x)
    part = F.split(s, ":")
    number = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    return (
        F.when(F.size(part) == 1, s.try_cast("double"))
        .when(F.size(part) == 2, number(1) * 60 + number(2))
        .when(F.size(part) == 3, number(1) * 3600 + number(2) * 60 + number(3))
    )


def contains_cjk(x: ColumnLike) -> Column:
    return F.coalesce(col(x).rlike(r"[\x{4e00}-\x{9fff}]"), F.lit(False))


def decay(t: ColumnLike, peak: ColumnLike, end: ColumnLike, alpha: float = 1.0, gamma: float = 1.0) -> Column:
    """1 up to ``peak``, falling to 0 at ``end``; a plain step where ``end`` is not after ``peak``."""
    t, peak, end = col(t), col(peak), col(end)
    span = F.when(end > peak, end - peak)
    fall = clamp(1 - lit_double(alpha) * F.pow(F.greatest((t - peak) / span, F.lit(0.0)), lit_double(gamma)))
    return (
        F.when(t.isNull(), F.lit(None).cast("double"))
        .when(t <= peak, F.lit(1.0))
        .when((end <= peak) | (t >= end), F.lit(0.0))
        .otherwise(fall)
    )


def micros_to_seconds(ts: ColumnLike) -> Column:
    """Seconds since the epoch of a timestamp with or without a zone (the session runs in UTC)."""
    return F.unix_micros(col(ts).cast("timestamp")) / lit_double(1e6)


def is_time(seconds: ColumnLike) -> Column:
    """Neither NULL nor NaN nor infinite."""
    s = col(seconds)
    return s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf")))


def ticks(seconds: ColumnLike, per_second: int = 1000) -> Column:
    """Whole ticks of a time in seconds, rounded half up. Filter by ``is_time`` before.

    floor(x + 0.5) rather than round(x), which goes through a decimal object for every value.
    """
    return F.floor(col(seconds) * per_second + F.lit(0.5))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``. Spark plans this as a WindowGroupLimit."""
    return (
        df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .filter(F.col("__rn") == 1)
        .drop("__rn")
    )


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
