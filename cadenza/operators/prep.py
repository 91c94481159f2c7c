"""Preparation of runs for evaluation: which files there are, what each path stands for, what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scalars import first_by

#: Subsets in the order in which they are tried, and kinds of a model's transcript, best first.
SUBSETS = ("1q1a_math", "1q1a", "1qna")
TRANSCRIPTS = ("precise_truncation.json", "wav_transcript_aligned.json", "wav_transcript.json", "output.json")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/?$", 1)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def with_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def resolved_outputs(wanted: DataFrame, listed: DataFrame, root: str) -> DataFrame:
    """(want_id, want_path) to a folder of ``listed`` (path): the path itself, else root/name, else
    root/subset/name (a subset that stands in the path comes first), else the only folder of that name below the
    root. Rows (want_id, path, rule); a name that occurs twice resolves to nothing.

    All rules are equi-joins on a few candidates per row; the best is a minimum over their places.
    """
    name, parts = file_name(F.col("want_path")), F.split(with_slashes(F.col("want_path")), "/")
    hinted = [F.array_contains(parts, s) for s in SUBSETS]
    place = lambda i: F.when(hinted[i], F.lit(2 + i)).otherwise(F.lit(2 + i + len(SUBSETS)))
    candidate = lambda at, path, rule: F.struct(at.alias("place"), path.alias("path"), F.lit(rule).alias("rule"))
    tried = F.array(candidate(F.lit(0), F.col("want_path"), "exact"), candidate(F.lit(1), F.concat(F.lit(f"{root}/"), name), "root"), *[candidate(place(i), F.concat(F.lit(f"{root}/{s}/"), name), "subset") for i, s in enumerate(SUBSETS)])
    there = listed.select("path").distinct()
    hits = wanted.select("want_id", F.explode(tried).alias("c")).select("want_id", "c.*").join(there, "path").groupBy("want_id").agg(F.min(F.struct("place", "path", "rule")).alias("hit"))
    below = there.filter(F.col("path").startswith(f"{root}/")).groupBy(file_name(F.col("path")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("only")).filter("n = 1")
    out = wanted.join(hits, "want_id", "left").withColumn("name", name).join(below, "name", "left")
    return out.select("want_id", F.coalesce("hit.path", "only").alias("path"), F.coalesce("hit.rule", F.when(F.col("only").isNotNull(), "name"), F.lit("none")).alias("rule"))


def scene_of_video(videos: DataFrame, scene_map: DataFrame) -> DataFrame:
    """Adds ``scene`` to rows with a ``video`` path: by the folder of one-question videos, else by the map
    (map_key as subset/path, map_scene), else by marks of nesting in the path, else multi_turn."""
    v = with_slashes(F.col("video"))
    key = F.regexp_extract(v, r"^.*?((?:1q1a_math|1q1a)/(?:(?!(?:1q1a_math|1q1a)/).)*)$", 1)
    marks = F.exists(F.array(*map(F.lit, ("/nested/", "/nested2/", "__nested__", "__nested2__"))), lambda m: v.contains(m))
    known = scene_map.filter("coalesce(map_scene, '') <> ''").dropDuplicates(["map_key"])
    out = videos.withColumn("map_key", key).join(known, "map_key", "left")
    one = F.lower(v).contains("/1qna/") | v.contains("videos_bench")
    return out.withColumn("scene", F.when(one, "1QnA").otherwise(F.coalesce("map_scene", F.when(marks, "nested"), F.lit("multi_turn")))).drop("map_key", "map_scene")


def annotation_candidates(video: Column, scene: Column, root: str = "data") -> Column:
    """Where the annotation of a video may lie, best first."""
    v = with_slashes(video)
    to_json = lambda p: F.concat(F.regexp_replace(p, r"\.[^./]*$", ""), F.lit(".json"))
    bench = F.regexp_extract(v, r"(?:^|/)videos_bench/(.+)$", 1)
    one = F.when(bench != "", F.array(F.concat(F.lit(f"{root}/1qna/annotations/"), to_json(bench)))).otherwise(F.array().cast("array<string>"))
    rest = [(s, F.regexp_replace(F.regexp_extract(v, rf"(?:^|.*?/){s}/(.+)$", 1), "^videos/", "")) for s in ("1q1a_math", "1q1a")]
    others = F.array_compact(F.array(*[F.when(r != "", F.concat(F.lit(f"{root}/{s}/annotations/"), to_json(r))) for s, r in rest]))
    return F.when(scene == "1QnA", one).otherwise(others)


def with_annotation(videos: DataFrame, listed: DataFrame, root: str = "data") -> DataFrame:
    """Adds ``annotation`` to rows (video_id, video, scene): the first candidate that is in ``listed`` (path)."""
    tried = videos.select("video_id", F.posexplode(annotation_candidates(F.col("video"), F.col("scene"), root)).alias("place", "path"))
    best = tried.join(listed.select("path").distinct(), "path").groupBy("video_id").agg(F.min_by("path", "place").alias("annotation"))
    return videos.join(best, "video_id", "left")


def best_transcript(files: DataFrame) -> DataFrame:
    """(folder, path) of the best kind of transcript in each folder of ``files`` (path)."""
    kind = F.array_position(F.array(*map(F.lit, TRANSCRIPTS)), file_name(F.col("path")))
    return files.withColumn("kind", kind).filter("kind > 0").groupBy(folder_of(F.col("path")).alias("folder")).agg(F.min_by("path", "kind").alias("path"))


def metric_files(items: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, passed on): the metric files of a summary's ok items and all that were found by name, each path once,
    the summary's first; items that are not ok are passed on as they are."""
    is_ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    listed = items.filter(is_ok & (F.coalesce("metric_json", F.lit("")) != "")).select(F.col("metric_json").alias("path"), "item_id", F.lit(0).alias("origin"))
    every = listed.unionByName(found.select("path", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(1).alias("origin")))
    plain = every.withColumn("path", F.regexp_replace(F.regexp_replace("path", r"/\./", "/"), "/{2,}", "/"))
    return first_by(plain, ["path"], [F.col("origin").asc(), F.col("item_id").asc()]), items.filter(~is_ok)


def collected(*sources: DataFrame) -> DataFrame:
    """Paths (path, position) of several sources, each once, where it was named first: (path, source, position)."""
    every = None
    for i, s in enumerate(sources):
        part = s.select("path", F.lit(i).alias("source"), F.col("position").cast("bigint").alias("position"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("path").agg(F.min(F.struct("source", "position")).alias("at")).select("path", "at.source", "at.position")


def discovered(entries: DataFrame, videos: DataFrame, root: str = "data") -> DataFrame:
    """Videos to run: those of the subsets' maps that exist, and all below the bench folder. (path, output_name, subset)."""
    name = lambda p: F.regexp_replace(F.replace(p, F.lit("/"), F.lit("__")), r"\.mp4", "")
    listed = entries.select(F.concat_ws("/", F.lit(root), "subset", "video").alias("path"), F.concat(F.col("subset"), F.lit("/"), name(F.col("video"))).alias("output_name"), "subset").join(videos.select("path").distinct(), "path", "left_semi")
    bench = f"{root}/1qna/videos_bench/"
    below = videos.filter(F.col("path").startswith(bench) & F.col("path").endswith(".mp4")).select("path", F.concat(F.lit("1qna/"), name(F.substr("path", F.lit(len(bench) + 1)))).alias("output_name"), F.lit("1qna").alias("subset"))
    return listed.unionByName(below)


def preparation_status(no_asr: bool = False, force_asr: bool = False, force_precise: bool = False, dry_run: bool = False) -> Column:
    """What became of a sample, from columns has_audio, has_transcript, precise_size, asr_size (NULL where there is no
    file), asr_code and precise_code (exit codes of the steps, 0 if they were not needed)."""
    there = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    runs_asr = (~there("asr_size") | F.lit(force_asr)) & F.lit(not no_asr)
    return (
        F.when(~(F.coalesce("has_audio", F.lit(False)) & F.coalesce("has_transcript", F.lit(False))), "missing_input")
        .when(there("precise_size") & F.lit(not force_precise), "skipped_existing")
        .when(runs_asr & (F.coalesce("asr_code", F.lit(0)) != 0), "failed_asr")
        .when(~runs_asr & ~there("asr_size"), "missing_asr_output")
        .when(F.coalesce("precise_code", F.lit(0)) != 0, "failed_precise")
        .otherwise("dry_run" if dry_run else "ok")
    )


def with_enough(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Rows whose key occurs ``least`` times or more; counted first, so that no key is gathered."""
    enough = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least).select(key)
    return rows.join(enough, key, "left_semi")


def failing_fast(rows: DataFrame, error: str, enabled: bool) -> DataFrame:
    """Rows with their error column, or, if ``enabled``, an end of the job at the first error."""
    return rows.withColumn(error, F.when(F.col(error).isNotNull(), F.raise_error(F.concat(F.lit("failed: "), F.col(error))).cast("string"))) if enabled else rows


def expired(files: DataFrame, now: Column, days: float) -> DataFrame:
    """Files (path, modificationTime) older than ``days``: what a daily clean-up would remove."""
    return files.filter(F.unix_micros(now) - F.unix_micros("modificationTime") > F.lit(int(days * 86_400_000_000)))


def scored_offline(records: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Offline answers with a score: 0 and ``missing_output`` where the run failed or said nothing, 0 and
    ``judge_error`` where no verdict came after all tries, else the verdict within 0 and 1."""
    said = (F.col("status") == "ok") & (F.trim(F.coalesce("answer", F.lit(""))) != "")
    out = records.join(verdicts.select(*keys, "verdict"), keys, "left").withColumn("__said", F.coalesce(said, F.lit(False)))
    source = F.when(~F.col("__said"), "missing_output").when(F.col("verdict").isNull(), "judge_error").otherwise("verdict")
    score = F.when(source == "verdict", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("verdict")))).otherwise(F.lit(0.0))
    return out.select(*keys, F.when(~F.col("__said"), F.coalesce("status", F.lit("error"))).when(F.col("verdict").isNull(), "judge_error").otherwise("ok").alias("status"), score.alias("score"), source.alias("parse_source"))
