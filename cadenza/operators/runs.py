"""Inference runs and manifests: latest and first per key, coverage, look-ups, path rules, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import first_by, safe_ratio
from cadenza.operators.series import running


def keep_first(rows: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    return first_by(rows, keys, [F.col(c).asc() for c in arrival])


def keep_last(rows: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    return first_by(rows, keys, [F.col(c).desc() for c in arrival])


def status_histogram(rows: DataFrame) -> DataFrame:
    """Runs by model and status; every status but ok is a failure."""
    return rows.groupBy("model_name", "status").agg(F.count(F.lit(1)).alias("n")).withColumn("is_failure", F.coalesce(F.col("status") != "ok", F.lit(True)))


def run_aggregate(rows: DataFrame) -> DataFrame:
    """Totals over ok runs; a missing status counts as ok, all others as failed."""
    ok = F.coalesce("status", F.lit("ok")) == "ok"
    return rows.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.coalesce(F.sum(F.when(ok, F.col("num_chunks"))), F.lit(0)).cast("bigint").alias("n_chunks"), F.coalesce(F.sum(F.when(ok, F.col("num_responses"))), F.lit(0)).cast("bigint").alias("n_responses"))


def real_time_factor(rows: DataFrame, least: float = 0.1) -> DataFrame:
    return rows.select("result_id", F.round(F.col("inference_sec") / F.greatest(F.col("duration_sec"), F.lit(least)), 6).alias("rtf"))


def latency_comparison(rows: DataFrame, session: list[str], side: str, value: str, order: list[str], is_error: Column, base: str, other: str, warm_up: int = 3) -> DataFrame:
    """Two groups side by side: count, mean, median, least and largest of ``value``, and how much the second
    differs, absolute and in percent. The first ``warm_up`` rows of a session are left out, and all of a
    session with an error.

    Values are counted in millionths, so that sums are exact and the same in whatever order they are taken.
    """
    key = [side, *session]
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    bad = rows.groupBy(*key).agg(F.max(F.coalesce(is_error, F.lit(False))).alias("__bad")).filter("__bad").select(*key)
    used = first.filter((F.col("__n") > warm_up) & F.col(value).isNotNull() & F.col(side).isin(base, other)).join(bad, key, "left_anti")
    millionths = F.round(F.col(value) * 1_000_000).cast("bigint")
    stats = used.withColumn("__v", millionths).groupBy(F.lit(1).alias("__one")).pivot(side, [base, other]).agg(F.count(F.lit(1)).alias("n"), F.sum("__v").alias("sum"), F.percentile("__v", 0.5).alias("p50"), F.min("__v").alias("min"), F.max("__v").alias("max"))
    c = lambda g, n: F.col(f"`{g}_{n}`")
    mean = lambda g: c(g, "sum") / c(g, "n") / F.lit(1e6)
    shown = {"n": lambda g: F.coalesce(c(g, "n"), F.lit(0)), "avg": mean} | {n: (lambda g, n=n: c(g, n) / F.lit(1e6)) for n in ("p50", "min", "max")}
    cols = [made(g).alias(f"{name}_{n}") for g, name in ((base, "base"), (other, "other")) for n, made in shown.items()]
    return stats.select(*cols, (mean(other) - mean(base)).alias("delta"), (100 * safe_ratio(mean(other) - mean(base), mean(base))).alias("delta_percent"))


def stage_statistics(rows: DataFrame, group: str, stages: list[str]) -> DataFrame:
    """Count, mean, least and largest of every stage by group: the stages become rows first; 0 if empty."""
    long = rows.select(group, *[F.col(s).cast("double").alias(s) for s in stages]).unpivot([group], stages, "stage", "value")
    zero = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 9).alias(name)
    return long.groupBy(group, "stage").agg(F.count("value").alias("n"), zero(F.avg("value"), "avg"), zero(F.min("value"), "min"), zero(F.max("value"), "max"))


def coverage(manifest: DataFrame, results: DataFrame, key: str, by: str) -> DataFrame:
    """How much of a manifest has a result."""
    done = results.select(key).distinct().withColumn("__done", F.lit(1))
    return manifest.join(done, key, "left").groupBy(by).agg(F.count(F.lit(1)).alias("n_listed"), F.count("__done").alias("n_done"), (F.count(F.lit(1)) - F.count("__done")).alias("n_missing"))


def missing(manifest: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return manifest.select(key).distinct().join(results.select(key), key, "left_anti")


def scene_of(subset: Column, path: Column) -> Column:
    """Scene by rules on the path: the first that fits."""
    return F.when(subset == "1qna", "1QnA").when(F.lower(path).contains("nested"), "nested").when(F.lower(path).contains("live"), "live").otherwise("multi_turn")


def path_parts(path: Column) -> list[Column]:
    """Name for outputs, stem, suffix and folder of a media path."""
    return [
        F.regexp_replace(F.replace(path, F.lit("/"), F.lit("__")), r"\.mp4$", "").alias("output_name"),
        F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"),
        F.regexp_extract(path, r"(\.[^./]*)$", 1).alias("suffix"),
        F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"),
    ]


def annotation_path(video: Column) -> Column:
    """Where the annotation of a video is to be found."""
    return F.concat(F.lit("annotations/"), F.regexp_extract(video, r"([^/]+)\.mp4$", 1), F.lit(".json"))


def resolve_candidates(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """(want_id, want_path) to the best of ``listed`` paths: the exact one, else the only one of that name.

    Both ways are equi-joins; a name that occurs twice resolves to nothing.
    """
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    exact = wanted.join(listed.select(F.col("path").alias("want_path"), F.lit(1).alias("__hit")).distinct(), "want_path", "left")
    single = listed.groupBy(name(F.col("path")).alias("__name")).agg(F.count(F.lit(1)).alias("__n"), F.min("path").alias("__only")).filter("__n = 1")
    out = exact.withColumn("__name", name(F.col("want_path"))).join(single, "__name", "left")
    return out.select("want_id", F.when(F.col("__hit") == 1, F.col("want_path")).otherwise(F.col("__only")).alias("path"), F.when(F.col("__hit") == 1, "exact").when(F.col("__only").isNotNull(), "name").otherwise("none").alias("rule"))


def preferred(rows: DataFrame, keys: list[str], kind: str, order: list[str]) -> DataFrame:
    """One row per key, of the kind that stands first in ``order``; kinds not listed come last."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(kind))
    return first_by(rows, keys, [F.when(rank == 0, len(order) + 1).otherwise(rank).asc(), F.col(kind).asc()])


def numbered(rows: DataFrame, key: str | None, order: str, width: int = 100_000) -> DataFrame:
    """Adds ``place``, from 0, of each row of a key (of all rows without one) in the order of a number. Rows meet by
    ranges of ``width`` of that number; a row per range carries how many came before."""
    keyed = rows.withColumn("__k", F.lit(0) if key is None else F.col(key))
    return running(keyed, "__k", [order], F.floor(F.col(order) / width), place=("sum", F.lit(1))).withColumn("place", F.col("place") - 1).drop("__k")


def shard(rows: DataFrame, order: str, shards: int, width: int = 100_000) -> DataFrame:
    """Adds ``shard``: rows dealt out one after the other in the order of a number."""
    return numbered(rows, None, order, width).withColumn("shard", (F.col("place") % shards).cast("int")).drop("place")


def stride(rows: DataFrame, key: str, order: str, step: int, width: int = 100_000) -> DataFrame:
    """Every ``step``-th row of a key, the first included."""
    return numbered(rows, key, order, width).filter(F.col("place") % step == 0).drop("place")


def sampled_frames(frames: Column, fps: Column, target: float = 1.0, most: int = 64) -> Column:
    """Numbers of the frames taken from a recording: ``target`` a second, and where these are more than ``most``,
    evenly fewer of them, ``most`` at most."""
    step = F.greatest(F.lit(1), F.floor(fps / target).cast("int"))
    taken = F.when(frames > 0, F.sequence(F.lit(0), (frames - 1).cast("int"), step)).otherwise(F.array().cast("array<int>"))
    again = F.greatest(F.lit(1), F.floor(F.size(taken) / most).cast("int"))
    fewer = F.slice(F.filter(taken, lambda v, i: i % again == 0), 1, most)
    return F.when(F.size(taken) > most, fewer).otherwise(taken)


def worker_counts(rows: DataFrame, busy: tuple[str, ...]) -> DataFrame:
    """Latest state of every worker, counted by kind."""
    latest = keep_last(rows, ["model_name"], ["finished_at", "result_id"])
    return latest.agg(F.count(F.lit(1)).alias("n_workers"), F.count_if(F.col("status") == "ok").alias("n_idle"), F.count_if(F.col("status").isin(*busy)).alias("n_busy"))
