"""Continuous periods and the gaps between them, from overlapping intervals per entity.

``session_window`` with a duration of its own for every row merges what overlaps, in one sorted
pass. An entity may hold a third of all rows, so the pass runs over (entity, stretch of media
time) and a second step joins the periods of neighbouring stretches. That step sees only what is
left after merging, and what crosses from one stretch to the next is one number per stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import is_time, ticks
from cadenza.session import cut_lineage

#: Media time handled as one group. Long enough to leave most recordings in one piece.
STRETCH_MS = 3_600_000


def _stretch_periods(intervals: DataFrame, keys: list[str], start: Column, end: Column, join_ms: int, stretch_ms: int) -> DataFrame:
    """Merged intervals per (keys, stretch): columns keys, __b, __s and __e in milliseconds."""
    kinds = dict(intervals.dtypes)
    named = [F.coalesce(F.col(k), F.lit("")).alias(k) if kinds[k] == "string" else F.col(k) for k in keys]
    # Filtered on the plain columns first: later steps then repeat no NULL checks.
    rows = (
        intervals.filter(is_time(start) & is_time(end))
        .select(*named, ticks(F.least(start, end)).alias("__s"), ticks(F.greatest(start, end)).alias("__e"))
        .withColumn("__b", F.floor(F.col("__s") / F.lit(stretch_ms)))
    )
    # A break of exactly join_ms still joins: the window is one microsecond longer than that.
    duration = F.expr("make_interval(0, 0, 0, 0, 0, 0, 0.001)") * (F.col("__e") - F.col("__s") + F.lit(join_ms + 0.001))
    at = F.timestamp_micros(F.col("__s") * 1000)
    merged = rows.withColumn("__at", at).groupBy(*keys, "__b", F.session_window("__at", duration).alias("__w")).agg(F.max("__e").alias("__e"))
    return merged.select(*keys, "__b", (F.unix_micros(F.col("__w.start")) / 1000).cast("bigint").alias("__s"), "__e")


def periods_and_gaps(
    intervals: DataFrame,
    keys: list[str],
    start: str = "start",
    end: str = "end",
    join_ms: int = 250,
    longest_gap_ms: int | None = 900_000,
    stretch_ms: int = STRETCH_MS,
) -> DataFrame:
    """Rows (keys, kind, start_ms, end_ms); kind is ``period`` or ``gap``.

    A period is a maximal stretch of intervals in which no break is longer than ``join_ms``. A gap
    is a break longer than that and, where ``longest_gap_ms`` is given, at most so long. Longer
    breaks part periods too but are not listed.

    Defined results: reversed endpoints are swapped; a row with a NULL, NaN or infinite time is left
    out; a repeated row and a nested interval add nothing; an interval of no length is a period of
    no length; a NULL string key is taken as ''; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    # Read three times below, and far smaller than the intervals.
    parts = cut_lineage(_stretch_periods(intervals, keys, F.col(start), F.col(end), join_ms, stretch_ms))
    by_stretch = Window.partitionBy(*keys, "__b").orderBy("__s")
    by_entity = Window.partitionBy(*keys).orderBy("__b")
    before = by_entity.rowsBetween(Window.unboundedPreceding, -1)
    after = by_entity.rowsBetween(1, Window.unboundedFollowing)

    # One row per stretch. Its periods are apart from each other, so only its ends matter outside.
    ends = parts.groupBy(*keys, "__b").agg(F.max("__e").alias("__top")).withColumn("__carry", F.max("__top").over(before))
    # What an earlier stretch still covers is part of a period begun there.
    is_start = F.col("__carry").isNull() | (F.col("__s") > F.col("__carry") + join_ms)
    starts = (
        parts.join(ends, [*keys, "__b"])
        .withColumn("__prev_top", F.lag("__e").over(by_stretch))
        .filter(is_start)
        .select(*keys, "__b", "__s", F.greatest("__carry", "__prev_top").alias("__before"))
    )
    # For the last start of a stretch, the end lies before the first start of a later stretch.
    next_start = starts.groupBy(*keys, "__b").agg(F.min_by("__before", "__s").alias("__first_before"))
    tops = ends.join(next_start, [*keys, "__b"], "left")
    tops = tops.select(
        *keys,
        "__b",
        F.coalesce(
            F.first("__first_before", ignorenulls=True).over(after),
            F.max("__top").over(Window.partitionBy(*keys)),
        ).alias("__until"),
    )
    full = (
        starts.join(tops, [*keys, "__b"])
        .withColumn("__end", F.coalesce(F.lead("__before").over(by_stretch), F.col("__until")))
    )
    gap_ok = F.col("__before").isNotNull()
    if longest_gap_ms is not None:
        gap_ok &= F.col("__s") - F.col("__before") <= longest_gap_ms
    row = lambda kind, s, e: F.struct(F.lit(kind).alias("kind"), s.alias("start_ms"), e.alias("end_ms"))
    out = F.array_compact(F.array(row("period", F.col("__s"), F.col("__end")), F.when(gap_ok, row("gap", F.col("__before"), F.col("__s")))))
    return full.select(*keys, F.explode(out).alias("__o")).select(*keys, "__o.kind", "__o.start_ms", "__o.end_ms")
