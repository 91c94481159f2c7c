"""Queues and clocks of a service: dispatch to workers, waiting times, clips, times of characters."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.series import folded


def first_in_first_out(jobs: DataFrame, pool: str, order: list[str], arrival: str, service: str, workers: int, capacity: int) -> DataFrame:
    """Adds ``starts_at`` of every job: at once if a worker is free, else when its turn comes; NULL if the
    queue is full when it arrives. A pool's only memory is its workers and the starts still ahead."""

    def step(state: list, at: float, seconds: float) -> tuple[list, float | None]:
        free, waiting = state
        while waiting and waiting[0] <= at:
            heapq.heappop(waiting)
        if free[0] > at and len(waiting) >= capacity:
            return state, None
        start = max(at, heapq.heappop(free))
        heapq.heappush(free, start + seconds)
        if start > at:
            heapq.heappush(waiting, start)
        return state, start

    return folded(jobs, pool, order, [arrival, service], lambda: [[0.0] * workers, []], step, "starts_at")


def waiting_estimate(remaining: Column, queued: Column, unit: float = 15.0) -> Column:
    """Seconds to wait: the mean time left of running jobs (``unit`` if none is known) and a unit for every
    job ahead, a second at least."""
    known = F.filter(remaining, lambda x: x.isNotNull())
    mean = F.coalesce(F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / F.when(F.size(known) > 0, F.size(known)), F.lit(unit))
    return F.greatest(F.lit(1.0), F.round(mean + (queued - 1) * unit))


def clip_bounds(duration: Column, length: float = 60.0) -> Column:
    """The first and the last ``length`` seconds of a recording, as an array of (part, start, end)."""
    clip = lambda part, a, b: F.struct(F.lit(part).alias("part"), a.alias("start"), b.alias("end"))
    return F.array(clip("first", F.lit(0.0), F.least(duration, F.lit(length))), clip("last", F.greatest(F.lit(0.0), duration - length), duration))


def time_of_phrase(words: Column, phrase: Column, fallback: Column) -> Column:
    """When a phrase begins in timed words (joined without separator), letter case aside; else ``fallback``.

    Every word knows at which letter it begins; the phrase's first letter falls into the last word that
    begins at or before it.
    """
    joined = F.lower(F.array_join(F.transform(words, lambda w: F.coalesce(w["text"], F.lit(""))), ""))
    at = F.instr(joined, F.lower(F.regexp_replace(phrase, "^[\"'“”‘’]+|[\"'“”‘’]+$", "")))
    start = F.struct(F.lit(1).alias("at"), F.lit(None).cast("double").alias("t"))
    walked = F.aggregate(words, start, lambda s, w: F.struct((s["at"] + F.length(F.coalesce(w["text"], F.lit("")))).alias("at"), F.when((s["at"] <= at) & w["start"].isNotNull() & (F.length(w["text"]) > 0), w["start"]).otherwise(s["t"]).alias("t")))
    return F.when(at > 0, F.coalesce(walked["t"], fallback)).otherwise(fallback)
