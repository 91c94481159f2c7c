"""Preparation: queries over the manifest and the runs, which stand for listings of files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import text as X
from cadenza.functions.scalars import clean_label
from cadenza.operators import prep as P
from cadenza.operators import timeline as T
from cadenza.plans import Query
from cadenza.sources.tables import once, table


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "sample_manifest", ["subset", "video", "annotation", "scene_type", "video_duration_sec"])


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "batch_result", ["model_name", "sample_id", "output_dir", "status", "attempt", "error", "rtf", "num_responses"])


def resolved_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Folders of one model's runs wanted by paths that are right, short of a part, or of another model."""
    runs = _runs(spark, folder)
    listed = runs.filter("model_name = 'quill_duplex'").select(F.col("output_dir").alias("path"))
    kind = F.pmod(F.col("result_id"), F.lit(4))
    name = P.file_name(F.col("output_dir"))
    wanted = runs.select(F.col("result_id").alias("want_id"), F.when(kind == 0, F.col("output_dir")).when(kind == 1, F.concat(F.lit("elsewhere/"), name)).when(kind == 2, F.concat(F.lit("old/1q1a/"), name)).otherwise(F.concat(F.lit("x/"), name, F.lit("_"))).alias("want_path"))
    return P.resolved_outputs(wanted, listed, "outputs/quill_duplex")


def video_scenes(spark: SparkSession, folder: str) -> DataFrame:
    m = _manifest(spark, folder)
    videos = m.select("sample_id", F.concat_ws("/", F.lit("data"), "subset", F.when(clean_label("scene_type") == "nested", F.concat(F.lit("nested/"), "video")).otherwise(F.col("video"))).alias("video"))
    mapped = m.filter("subset <> '1qna' AND video_duration_sec IS NOT NULL").select(F.concat_ws("/", "subset", "video").alias("map_key"), clean_label("scene_type").alias("map_scene"))
    return P.scene_of_video(videos, mapped).select("sample_id", "scene")


def video_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Annotations of videos, where they are: none is there for a video of unknown length."""
    m = _manifest(spark, folder)
    scene = F.when(F.col("subset") == "1qna", "1QnA").otherwise("multi_turn")
    videos = m.select(F.col("sample_id").alias("video_id"), F.when(F.col("subset") == "1qna", F.concat(F.lit("data/1qna/videos_bench/ds/"), P.file_name(F.col("video")))).otherwise(F.concat_ws("/", F.lit("/x/data"), "subset", "video")).alias("video"), scene.alias("scene"))
    stem = F.regexp_replace(P.file_name(F.col("video")), r"\.[^.]*$", "")
    listed = m.filter("video_duration_sec IS NOT NULL").select(F.when(F.col("subset") == "1qna", F.concat(F.lit("data/1qna/annotations/ds/"), stem, F.lit(".json"))).otherwise(F.concat(F.lit("data/"), F.col("subset"), F.lit("/annotations/"), stem, F.lit(".json"))).alias("path"))
    return P.with_annotation(videos, listed).select("video_id", "annotation")


def best_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """The best transcript in the folder of each run; how far a run came tells which kinds there are."""
    came = (F.col("num_responses") > 100, F.col("num_responses") > 20, F.col("rtf").isNotNull(), F.col("status") != "error")
    kinds = F.array(*[F.when(c, F.lit(n)) for c, n in zip(came, P.TRANSCRIPTS, strict=True)], F.lit("output.wav"))
    files = _runs(spark, folder).select("output_dir", F.explode(F.array_compact(kinds)).alias("name"))
    return P.best_transcript(files.select(F.concat_ws("/", "output_dir", "name").alias("path")))


def metric_files(spark: SparkSession, folder: str) -> DataFrame:
    """Metric files of ok runs and those that were found, and the runs passed on."""
    items = _runs(spark, folder).select(F.col("result_id").alias("item_id"), "status", F.concat(F.col("output_dir"), F.lit("/./m.json")).alias("metric_json"))
    found = _runs(spark, folder).filter("attempt = 1").select(F.concat(F.col("output_dir"), F.lit("//m.json")).alias("path"))
    files, passed = P.metric_files(items, found)
    return files.select("path", "item_id", F.lit("file").alias("kind")).unionByName(passed.select(F.col("status").alias("path"), "item_id", F.lit("passed").alias("kind")))


def sample_dirs(spark: SparkSession, folder: str) -> DataFrame:
    """Folders named by hand, by a list, by a summary and by their audio, each once."""
    runs = _runs(spark, folder).select("result_id", F.col("output_dir").alias("path"), "status", F.col("result_id").alias("position"))
    return P.collected(runs.filter("status = 'incomplete'"), runs.filter("status = 'error'"), runs.filter("status = 'ok'"), runs)


def discovered_videos(spark: SparkSession, folder: str) -> DataFrame:
    m = _manifest(spark, folder)
    there = m.filter("video_duration_sec IS NOT NULL").select(F.when(F.col("subset") == "1qna", F.concat(F.lit("data/1qna/videos_bench/"), F.col("video"))).otherwise(F.concat_ws("/", F.lit("data"), "subset", "video")).alias("path"))
    return P.discovered(m.filter("subset <> '1qna'").select("subset", "video"), there)


def preparation_status(spark: SparkSession, folder: str) -> DataFrame:
    """The state of every run's sample, from files that its number stands for."""
    i = F.col("result_id")
    made = _runs(spark, folder).select(
        "result_id", (i % 11 != 0).alias("has_audio"), (i % 13 != 0).alias("has_transcript"), F.when(i % 4 == 0, i % 8).alias("precise_size"), F.when(i % 3 != 0, i % 5).alias("asr_size"), F.when(i % 7 == 0, 1).otherwise(0).alias("asr_code"), F.when(i % 17 == 0, 2).otherwise(0).alias("precise_code")
    )
    return made.select("result_id", P.preparation_status().alias("status"), P.preparation_status(no_asr=True, force_precise=True, dry_run=True).alias("status_without_asr"))


def multi_question_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Slots of samples that ask two questions or more."""
    s = T.clean_slots(spark, folder, ("scene_type",)).filter(clean_label("scene_type") == "1qna")
    return P.with_enough(s, "sample_id", 2).select("slot_uid", "sample_id")


def precise_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks cut to what was heard of them: the words of the same model and sample that touch a chunk, 0.15 s of
    tolerance, in order, cover a part of its text."""
    c = T.clean_chunks(spark, folder, ("text", "aligned_words")).filter("aligned_words IS NOT NULL").withColumn("k", F.concat_ws("|", "model_name", "sample_id"))
    words = c.select("k", "chunk_id", F.posexplode("aligned_words").alias("i", "w")).filter("w.start IS NOT NULL AND w.end IS NOT NULL")
    words = words.select("k", F.struct(F.col("w.start").alias("a"), F.col("w.end").alias("b"), "chunk_id", "i", F.col("w.text").alias("x")).alias("l_id"), F.least("w.start", "w.end").alias("l_low"), F.greatest("w.start", "w.end").alias("l_high"))
    whole = c.select("k", F.col("chunk_id").alias("r_id"), F.col("chunk_start").alias("r_low"), F.col("chunk_end").alias("r_high"))
    heard = T.overlap_join(words, whole, "k", 0.15).groupBy("k", F.col("r_id").alias("chunk_id")).agg(F.transform(F.array_sort(F.collect_list("l_id")), lambda w: w["x"]).alias("tokens"))
    out = c.join(heard, ["k", "chunk_id"]).withColumn("text", X.covered_prefix("text", F.col("tokens")))
    return out.filter(F.trim("text") != "").select("model_name", "sample_id", "chunk_id", "text")


def offline_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Answers scored by a table of verdicts, which lacks those of scenes without one."""
    u = once(spark, folder, "unified_eval", ["actual_text", "tp_n", "is_interrupted"])
    records = u.select("eval_id", F.when(F.col("eval_id") % 10 == 0, "error").otherwise("ok").alias("status"), F.col("actual_text").alias("answer"))
    verdicts = u.filter("NOT is_interrupted").select("eval_id", (F.col("tp_n") * 2).alias("verdict"))
    return P.scored_offline(records, verdicts, ["eval_id"])


def errors_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with their errors beside them; with ``enabled`` the first would end the job."""
    r = once(spark, folder, "batch_result", ["error"])
    return P.failing_fast(r.select("result_id", "error"), "error", enabled=False)


def expired_files(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as files: those older than 1,000 days at the end of 1998 are due for removal."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").cast("timestamp").alias("modificationTime"))
    return P.expired(o, F.lit("1998-12-31 00:00:00").cast("timestamp"), 1000).select("path")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (resolved_outputs, video_scenes, video_annotations, best_transcripts, metric_files, sample_dirs, discovered_videos, preparation_status, multi_question_slots, precise_chunks, offline_scores, errors_kept, expired_files)
}
_M = "m AS (SELECT DISTINCT ON (sample_id) * FROM sample_manifest)"
_R = "r AS (SELECT DISTINCT ON (result_id) * FROM batch_result)"
_NAME = r"regexp_extract({}, '([^/]+)/?$', 1)"
_STEM = rf"regexp_replace({_NAME.format('video')}, '\.[^.]*$', '')"
_STATUS = """CASE WHEN NOT (result_id % 11 <> 0 AND result_id % 13 <> 0) THEN 'missing_input' WHEN {fp} AND coalesce(ps > 0, false) THEN 'skipped_existing' WHEN {ra} AND ac <> 0 THEN 'failed_asr' WHEN NOT ({ra}) AND NOT coalesce(sz > 0, false) THEN 'missing_asr_output' WHEN pc <> 0 THEN 'failed_precise' ELSE '{ok}' END"""
ORACLES = {
    "resolved_outputs": f"""WITH {_R}, l AS (SELECT DISTINCT output_dir AS path FROM r WHERE model_name = 'quill_duplex'), n AS (SELECT *, {_NAME.format('output_dir')} AS nm FROM r),
w AS (SELECT result_id AS want_id, nm, CASE result_id % 4 WHEN 0 THEN output_dir WHEN 1 THEN 'elsewhere/' || nm WHEN 2 THEN 'old/1q1a/' || nm ELSE 'x/' || nm || '_' END AS wp FROM n),
v AS (SELECT *, {_NAME.format('wp')} AS wn FROM w), c AS (SELECT want_id, 0 AS pl, wp AS p, 'exact' AS rule FROM v UNION ALL SELECT want_id, 1, 'outputs/quill_duplex/' || wn, 'root' FROM v
  UNION ALL SELECT want_id, CASE WHEN list_contains(string_split(wp, '/'), s) THEN 2 ELSE 5 END + o, 'outputs/quill_duplex/' || s || '/' || wn, 'subset' FROM v, (VALUES ('1q1a_math', 0), ('1q1a', 1), ('1qna', 2)) t(s, o)),
h AS (SELECT want_id, arg_min(p, pl) AS p, arg_min(rule, pl) AS rule FROM c JOIN l ON l.path = c.p GROUP BY want_id), u AS (SELECT {_NAME.format('path')} AS nm, min(path) AS only FROM l GROUP BY 1 HAVING count(*) = 1)
SELECT v.want_id, coalesce(h.p, u.only) AS path, coalesce(h.rule, CASE WHEN u.only IS NOT NULL THEN 'name' END, 'none') AS rule FROM v LEFT JOIN h ON h.want_id = v.want_id LEFT JOIN u ON u.nm = v.wn""",
    "best_transcripts": f"""WITH {_R}, k AS (SELECT output_dir, CASE WHEN num_responses > 100 THEN 1 WHEN num_responses > 20 THEN 2 WHEN rtf IS NOT NULL THEN 3 WHEN status <> 'error' THEN 4 END AS k FROM r), b AS (SELECT output_dir, min(k) AS k FROM k WHERE k IS NOT NULL GROUP BY ALL)
SELECT output_dir AS folder, output_dir || '/' || CASE k WHEN 1 THEN 'precise_truncation.json' WHEN 2 THEN 'wav_transcript_aligned.json' WHEN 3 THEN 'wav_transcript.json' ELSE 'output.json' END AS path FROM b""",
    "metric_files": f"""WITH {_R}, a AS (SELECT output_dir || '/m.json' AS path, result_id AS item_id, 0 AS o FROM r WHERE status = 'ok' UNION ALL SELECT output_dir || '/m.json', NULL, 1 FROM r WHERE attempt = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY o, item_id) AS n FROM a) SELECT path, item_id, 'file' AS kind FROM k WHERE n = 1 UNION ALL SELECT status, result_id, 'passed' FROM r WHERE coalesce(status <> 'ok', true)""",
    "sample_dirs": f"""WITH {_R}, a AS (SELECT output_dir AS path, 0 AS source, result_id AS position FROM r WHERE status = 'incomplete' UNION ALL SELECT output_dir, 1, result_id FROM r WHERE status = 'error' UNION ALL SELECT output_dir, 2, result_id FROM r WHERE status = 'ok' UNION ALL SELECT output_dir, 3, result_id FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY source, position) AS n FROM a) SELECT path, source, position FROM k WHERE n = 1""",
    "video_scenes": rf"""WITH {_M}, l AS (SELECT *, lower(regexp_replace(scene_type, '^\s+|\s+$', '', 'g')) AS sc FROM m), x AS (SELECT sample_id, subset, CASE WHEN sc = 'nested' THEN 'nested/' || video ELSE video END AS v FROM l), k AS (SELECT DISTINCT subset || '/' || video AS key, sc FROM l WHERE subset <> '1qna' AND video_duration_sec IS NOT NULL)
SELECT sample_id, CASE WHEN subset = '1qna' THEN '1QnA' ELSE coalesce(nullif(k.sc, ''), CASE WHEN starts_with(v, 'nested/') THEN 'nested' END, 'multi_turn') END AS scene FROM x LEFT JOIN k ON k.key = subset || '/' || v AND subset <> '1qna'""",
    "video_annotations": rf"""WITH {_M} SELECT sample_id AS video_id, CASE WHEN video_duration_sec IS NOT NULL THEN CASE WHEN subset = '1qna' THEN 'data/1qna/annotations/ds/' || {_STEM} || '.json' ELSE 'data/' || subset || '/annotations/' || {_STEM} || '.json' END END AS annotation FROM m""",
    "discovered_videos": f"""WITH {_M} SELECT CASE WHEN subset = '1qna' THEN 'data/1qna/videos_bench/' || video ELSE 'data/' || subset || '/' || video END AS path, subset || '/' || replace(replace(video, '/', '__'), '.mp4', '') AS output_name, subset FROM m WHERE video_duration_sec IS NOT NULL""",
    "preparation_status": f"""WITH {_R}, x AS (SELECT result_id, CASE WHEN result_id % 4 = 0 THEN result_id % 8 END AS ps, CASE WHEN result_id % 3 <> 0 THEN result_id % 5 END AS sz, CASE WHEN result_id % 7 = 0 THEN 1 ELSE 0 END AS ac, CASE WHEN result_id % 17 = 0 THEN 2 ELSE 0 END AS pc FROM r)
SELECT result_id, {_STATUS.format(fp='true', ra='NOT coalesce(sz > 0, false)', ok='ok')} AS status, {_STATUS.format(fp='false', ra='false', ok='dry_run')} AS status_without_asr FROM x""",
    "multi_question_slots": r"""WITH s AS (SELECT DISTINCT ON (slot_uid) * FROM slots WHERE start IS NOT NULL AND "end" IS NOT NULL AND t_a IS NOT NULL), q AS (SELECT * FROM s WHERE lower(regexp_replace(scene_type, '^\s+|\s+$', '', 'g')) = '1qna') SELECT slot_uid, sample_id FROM q WHERE sample_id IN (SELECT sample_id FROM q GROUP BY sample_id HAVING count(*) >= 2)""",
    "offline_scores": r"""WITH u AS (SELECT DISTINCT ON (eval_id) eval_id, eval_id % 10 = 0 AS bad, is_interrupted AS nv, tp_n * 2 AS vd, coalesce(regexp_replace(actual_text, '^ +| +$', '', 'g'), '') AS a FROM unified_eval)
SELECT eval_id, CASE WHEN bad THEN 'error' WHEN a = '' THEN 'ok' WHEN nv OR vd IS NULL THEN 'judge_error' ELSE 'ok' END AS status, CASE WHEN bad OR a = '' OR nv OR vd IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, vd)) END AS score, CASE WHEN bad OR a = '' THEN 'missing_output' WHEN nv OR vd IS NULL THEN 'judge_error' ELSE 'verdict' END AS parse_source FROM u""",
    "errors_kept": f"WITH {_R} SELECT result_id, error FROM r",
    "expired_files": "SELECT CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE epoch_us(TIMESTAMP '1998-12-31 00:00:00') - epoch_us(CAST(o_orderdate AS TIMESTAMP)) > 1000 * 86400000000::BIGINT",
}
