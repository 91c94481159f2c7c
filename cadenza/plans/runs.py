"""Runs, manifests and paths: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.scalars import clean_label, micros_to_seconds, safe_ratio
from cadenza.operators import runs as R
from cadenza.plans import Query
from cadenza.sources.tables import once, table


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "batch_result")


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "sample_manifest")


def dedupe_last(spark: SparkSession, folder: str) -> DataFrame:
    return R.keep_last(_runs(spark, folder), ["model_name", "sample_id"], ["attempt", "result_id"]).select("model_name", "sample_id", "attempt", "status")


def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    return R.keep_first(_runs(spark, folder), ["model_name", "sample_id"], ["attempt", "result_id"]).select("model_name", "sample_id", "attempt", "status")


def status_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return R.status_histogram(_runs(spark, folder))


def run_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return R.run_aggregate(R.keep_last(_runs(spark, folder), ["model_name", "sample_id"], ["attempt", "result_id"]))


def rtf(spark: SparkSession, folder: str) -> DataFrame:
    return R.real_time_factor(_runs(spark, folder))


def latency_ab(spark: SparkSession, folder: str) -> DataFrame:
    """Two workers side by side: a user's events of a day are a session, its first three are warm-up."""
    e = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("worker"), F.floor(micros_to_seconds("ts") / 864000).alias("day"))
    return R.latency_comparison(e, ["user_id", "day"], "worker", "value", ["ts", "event_id"], F.col("event_type") == "error", "even", "odd")


def stage_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return R.stage_statistics(_runs(spark, folder), "status", ["inference_sec", "duration_sec", "rtf", "num_chunks", "num_responses"])


def mean_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).groupBy("model_name").agg(F.count("inference_sec").alias("n"), F.round(safe_ratio(F.sum("inference_sec"), F.count("inference_sec")), 6).alias("mean_inference"))


def worker_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.worker_counts(_runs(spark, folder), ("incomplete", "error"))


def skip_existing(spark: SparkSession, folder: str) -> DataFrame:
    """What is still to run: listed samples without an ok run of a model."""
    listed = _manifest(spark, folder).select("sample_id")
    models = _runs(spark, folder).select("model_name").distinct()
    done = _runs(spark, folder).filter("status = 'ok'").select("model_name", "sample_id")
    # All models in one array: a row whose size is that of their names, whatever the number of runs.
    every = models.agg(F.array_sort(F.collect_set("model_name")).alias("models"))
    todo = listed.crossJoin(F.broadcast(every)).select("sample_id", F.explode("models").alias("model_name"))
    return todo.join(done, ["model_name", "sample_id"], "left_anti")


def manifest_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return R.coverage(_manifest(spark, folder), _runs(spark, folder).filter("status = 'ok'"), "sample_id", "subset")


def coverage_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Set operations on keys: in both, only listed, only run, in either."""
    a, b = _manifest(spark, folder).select("sample_id"), _runs(spark, folder).select("sample_id")
    count = lambda name, df: df.agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count("both", a.intersect(b)).unionByName(count("only_listed", a.subtract(b))).unionByName(count("only_run", b.subtract(a))).unionByName(count("either", a.union(b).distinct()))


def missing_report(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten missing and how many more: a top-k report."""
    gone = R.missing(_manifest(spark, folder), _runs(spark, folder).filter("status = 'ok' AND attempt = 1"), "sample_id")
    first = gone.orderBy("sample_id").limit(10).agg(F.array_join(F.array_sort(F.collect_list("sample_id")), ",").alias("first_ten"))
    return first.crossJoin(gone.agg(F.greatest(F.count(F.lit(1)) - 10, F.lit(0)).alias("n_more")))


def manifest_enrich(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with the manifest's scene and duration, the run's own duration where the manifest has none."""
    m = _manifest(spark, folder).select("sample_id", "subset", clean_label("scene_type").alias("scene_type"), "video_duration_sec")
    return _runs(spark, folder).join(m, "sample_id", "left").select("result_id", "subset", "scene_type", F.coalesce("video_duration_sec", "duration_sec").alias("duration"))


def scene_rules(spark: SparkSession, folder: str) -> DataFrame:
    m = _manifest(spark, folder)
    return m.select("sample_id", R.scene_of(F.col("subset"), F.col("video")).alias("scene"), R.annotation_path(F.col("video")).alias("annotation_path"))


def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    return _manifest(spark, folder).select("sample_id", *R.path_parts(F.concat_ws("/", "subset", "video")))


def resolve_outputs(spark: SparkSession, folder: str) -> DataFrame:
    wanted = _manifest(spark, folder).select(F.col("sample_id").alias("want_id"), F.concat(F.lit("outputs/quill_duplex/"), F.regexp_replace("sample_id", "^([^_]+(?:_math)?)__", "$1/")).alias("want_path"))
    listed = _runs(spark, folder).filter("model_name = 'quill_duplex'").select(F.col("output_dir").alias("path")).distinct()
    return R.resolve_candidates(wanted, listed)


def preferred_run(spark: SparkSession, folder: str) -> DataFrame:
    """Per sample the run of the kind that comes first: ok, incomplete, error."""
    runs = R.keep_last(_runs(spark, folder), ["sample_id", "status"], ["finished_at", "result_id"])
    return R.preferred(runs, ["sample_id"], "status", ["ok", "incomplete", "error"]).select("sample_id", "status", "result_id")


def union_passthrough(spark: SparkSession, folder: str) -> DataFrame:
    """Ok runs with their measures, and all others passed on without."""
    runs = _runs(spark, folder)
    ok = runs.filter("status = 'ok'").select("result_id", "status", "rtf")
    rest = runs.filter("status <> 'ok' OR status IS NULL").select("result_id", "status")
    return ok.unionByName(rest, allowMissingColumns=True)


def required_models(spark: SparkSession, folder: str) -> DataFrame:
    """Models that are required and have no run."""
    need = spark.createDataFrame([(m,) for m in ("quill_duplex", "merle_stream", "ostrea_omni_8b", "larkvoice_rt", "not_there")], "model_name string")
    return need.exceptAll(_runs(spark, folder).select("model_name").distinct())


def ordered_items(spark: SparkSession, folder: str) -> DataFrame:
    """All items by their number where the name ends in one, then by name."""
    m = _manifest(spark, folder).select("sample_id", F.regexp_extract("sample_id", r"(\d+)$", 1).try_cast("int").alias("item_index"))
    return m.orderBy(F.col("item_index").isNull(), "item_index", "sample_id")


def message_tails(spark: SparkSession, folder: str) -> DataFrame:
    """Long messages cut to what a report has room for."""
    return _runs(spark, folder).filter("error IS NOT NULL").select("result_id", F.left("error", F.lit(12)).alias("head"), F.right("error", F.lit(16)).alias("tail"))


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """Runs dealt out to eight shards in the order of their numbers."""
    return R.shard(_runs(spark, folder), "result_id", 8).select("result_id", "shard")


def stride_sample(spark: SparkSession, folder: str) -> DataFrame:
    return R.stride(_runs(spark, folder), "model_name", "result_id", 5).select("model_name", "result_id")


def sampled_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of every recording of known length at 29.97 a second: one a second, 64 at most."""
    m = _manifest(spark, folder).filter("video_duration_sec IS NOT NULL")
    frames = F.floor(F.col("video_duration_sec") * 29.97)
    return m.select("sample_id", F.explode(R.sampled_frames(frames, F.lit(29.97))).alias("frame"))


def previous_run(spark: SparkSession, folder: str) -> DataFrame:
    """Each run with what the run before it on the same sample gave: metadata carried over by key."""
    runs = _runs(spark, folder).select("model_name", "sample_id", "attempt", "status")
    before = runs.select("model_name", "sample_id", (F.col("attempt") + 1).alias("attempt"), F.col("status").alias("previous_status"))
    return runs.join(before, ["model_name", "sample_id", "attempt"], "left")


def average_over_ok(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of a measure over ok rows, and how many rows have none."""
    r = _runs(spark, folder)
    return r.groupBy("model_name").agg(F.round(safe_ratio(F.sum(F.when(F.col("status") == "ok", F.col("rtf"))), F.count(F.when(F.col("status") == "ok", F.col("rtf")))), 6).alias("mean_rtf"), F.count_if(F.col("rtf").isNull()).alias("n_without"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (dedupe_last, dedupe_first, status_histogram, run_aggregate, rtf, latency_ab, stage_statistics, mean_by_model, worker_counts, skip_existing, manifest_coverage, coverage_sets, missing_report, manifest_enrich, scene_rules, path_parts, resolve_outputs, preferred_run, union_passthrough, required_models, ordered_items, message_tails, shards, stride_sample, sampled_frames, previous_run, average_over_ok)
}
_R = "WITH r AS (SELECT DISTINCT ON (result_id) * FROM batch_result), m AS (SELECT DISTINCT ON (sample_id) * FROM sample_manifest)"
_ONE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name, sample_id ORDER BY attempt {0}, result_id {0}) AS rn FROM r) WHERE rn = 1"
ORACLES = {
    "dedupe_last": f"{_R}, l AS ({_ONE.format('DESC')}) SELECT model_name, sample_id, attempt, status FROM l",
    "dedupe_first": f"{_R}, l AS ({_ONE.format('ASC')}) SELECT model_name, sample_id, attempt, status FROM l",
    "status_histogram": f"{_R} SELECT model_name, status, count(*) AS n, coalesce(status <> 'ok', true) AS is_failure FROM r GROUP BY ALL",
    "run_aggregate": f"{_R}, l AS ({_ONE.format('DESC')}), k AS (SELECT *, coalesce(status, 'ok') = 'ok' AS ok FROM l) SELECT model_name, count(*) AS n_runs, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed, CAST(coalesce(sum(num_chunks) FILTER (ok), 0) AS BIGINT) AS n_chunks, CAST(coalesce(sum(num_responses) FILTER (ok), 0) AS BIGINT) AS n_responses FROM k GROUP BY ALL",
    "rtf": f"{_R} SELECT result_id, round(inference_sec / greatest(duration_sec, 0.1), 6) AS rtf FROM r",
    "latency_ab": """WITH e AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS g, floor(epoch_us(ts) / 1e6 / 864000) AS day FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY g, user_id, day ORDER BY ts, event_id) AS i, bool_or(event_type = 'error') OVER (PARTITION BY g, user_id, day) AS bad FROM e),
u AS (SELECT g, CAST(round(value * 1000000) AS BIGINT) AS v FROM n WHERE i > 3 AND NOT bad AND value IS NOT NULL),
s AS (SELECT g, count(*) AS n, sum(v)::DOUBLE / count(*) / 1e6 AS a, quantile_cont(v::DOUBLE, 0.5) / 1e6 AS p, min(v)::DOUBLE / 1e6 AS lo, max(v)::DOUBLE / 1e6 AS hi FROM u GROUP BY g)
SELECT b.n AS base_n, b.a AS base_avg, b.p AS base_p50, b.lo AS base_min, b.hi AS base_max, o.n AS other_n, o.a AS other_avg, o.p AS other_p50, o.lo AS other_min, o.hi AS other_max, o.a - b.a AS delta, 100 * ((o.a - b.a) / b.a) AS delta_percent FROM s b, s o WHERE b.g = 'even' AND o.g = 'odd'""",
    "stage_statistics": f"""{_R}, l AS (SELECT status, unnest(['inference_sec', 'duration_sec', 'rtf', 'num_chunks', 'num_responses']) AS stage, unnest([inference_sec, duration_sec, rtf, CAST(num_chunks AS DOUBLE), CAST(num_responses AS DOUBLE)]) AS value FROM r)
SELECT status, stage, count(value) AS n, round(coalesce(avg(value), 0), 9) AS avg, round(coalesce(min(value), 0), 9) AS min, round(coalesce(max(value), 0), 9) AS max FROM l GROUP BY ALL""",
    "mean_by_model": f"{_R} SELECT model_name, count(inference_sec) AS n, round(CASE WHEN count(inference_sec) > 0 THEN sum(inference_sec) / count(inference_sec) ELSE 0 END, 6) AS mean_inference FROM r GROUP BY ALL",
    "worker_counts": f"{_R}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY (SELECT min(b.finished_at) FROM batch_result b WHERE b.result_id = r.result_id) DESC, result_id DESC) AS rn FROM r) WHERE rn = 1) SELECT count(*) AS n_workers, count(*) FILTER (status = 'ok') AS n_idle, count(*) FILTER (status IN ('incomplete', 'error')) AS n_busy FROM l",
    "skip_existing": f"{_R} SELECT k.model_name, m.sample_id FROM m, (SELECT DISTINCT model_name FROM r) k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.model_name = k.model_name AND r.sample_id = m.sample_id AND r.status = 'ok')",
    "manifest_coverage": f"{_R}, d AS (SELECT DISTINCT sample_id FROM r WHERE status = 'ok') SELECT subset, count(*) AS n_listed, count(d.sample_id) AS n_done, count(*) - count(d.sample_id) AS n_missing FROM m LEFT JOIN d ON m.sample_id = d.sample_id GROUP BY subset",
    "coverage_sets": f"{_R}, a AS (SELECT DISTINCT sample_id FROM m), b AS (SELECT DISTINCT sample_id FROM r) SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_listed', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_run', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)",
    "missing_report": f"{_R}, g AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS rn FROM m WHERE sample_id NOT IN (SELECT sample_id FROM r WHERE status = 'ok' AND attempt = 1)) SELECT coalesce(string_agg(sample_id, ',' ORDER BY sample_id) FILTER (rn <= 10), '') AS first_ten, greatest(count(*) - 10, 0) AS n_more FROM g",
    "manifest_enrich": rf"{_R} SELECT result_id, subset, lower(regexp_replace(scene_type, '^\s+|\s+$', '', 'g')) AS scene_type, coalesce(video_duration_sec, duration_sec) AS duration FROM r LEFT JOIN m ON r.sample_id = m.sample_id",
    "scene_rules": rf"{_R} SELECT sample_id, CASE WHEN subset = '1qna' THEN '1QnA' WHEN lower(video) LIKE '%nested%' THEN 'nested' WHEN lower(video) LIKE '%live%' THEN 'live' ELSE 'multi_turn' END AS scene, 'annotations/' || regexp_extract(video, '([^/]+)\.mp4$', 1) || '.json' AS annotation_path FROM m",
    "path_parts": rf"{_R}, x AS (SELECT sample_id, subset || '/' || video AS p FROM m) SELECT sample_id, regexp_replace(replace(p, '/', '__'), '\.mp4$', '') AS output_name, regexp_extract(p, '([^/]+?)(\.[^./]*)?$', 1) AS stem, regexp_extract(p, '(\.[^./]*)$', 1) AS suffix, regexp_extract(p, '^(.*)/[^/]*$', 1) AS folder FROM x",
    "resolve_outputs": rf"""{_R}, w AS (SELECT sample_id AS want_id, 'outputs/quill_duplex/' || regexp_replace(sample_id, '^([^_]+(?:_math)?)__', '\1/') AS wp FROM m), l AS (SELECT DISTINCT output_dir AS path FROM r WHERE model_name = 'quill_duplex'),
s AS (SELECT regexp_extract(path, '([^/]+)$', 1) AS nm, min(path) AS sole FROM l GROUP BY ALL HAVING count(*) = 1)
SELECT want_id, CASE WHEN l.path IS NOT NULL THEN wp ELSE sole END AS path, CASE WHEN l.path IS NOT NULL THEN 'exact' WHEN sole IS NOT NULL THEN 'name' ELSE 'none' END AS rule FROM w LEFT JOIN l ON l.path = wp LEFT JOIN s ON s.nm = regexp_extract(wp, '([^/]+)$', 1)""",
    "preferred_run": f"""WITH r AS (SELECT result_id, sample_id, status, min(finished_at) AS finished_at FROM batch_result GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY sample_id, status ORDER BY finished_at DESC, result_id DESC) AS a FROM r)
SELECT sample_id, status, result_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY CASE status WHEN 'ok' THEN 1 WHEN 'incomplete' THEN 2 WHEN 'error' THEN 3 ELSE 4 END, status) AS b FROM l WHERE a = 1) WHERE b = 1""",
    "union_passthrough": f"{_R} SELECT result_id, status, CASE WHEN status = 'ok' THEN rtf END AS rtf FROM r",
    "required_models": f"{_R} SELECT * FROM (VALUES ('quill_duplex'), ('merle_stream'), ('ostrea_omni_8b'), ('larkvoice_rt'), ('not_there')) AS t(model_name) WHERE model_name NOT IN (SELECT model_name FROM r)",
    "ordered_items": rf"{_R} SELECT sample_id, TRY_CAST(regexp_extract(sample_id, '(\d+)$', 1) AS INTEGER) AS item_index FROM m ORDER BY item_index IS NULL, item_index, sample_id",
    "message_tails": f"{_R} SELECT result_id, left(error, 12) AS head, right(error, 16) AS tail FROM r WHERE error IS NOT NULL",
    "shards": f"{_R} SELECT result_id, CAST((row_number() OVER (ORDER BY result_id) - 1) % 8 AS INTEGER) AS shard FROM r",
    "sampled_frames": f"{_R}, x AS (SELECT sample_id, range(0, CAST(floor(video_duration_sec * 29.97::DOUBLE) AS BIGINT), 29) AS f FROM m WHERE video_duration_sec IS NOT NULL), y AS (SELECT sample_id, CASE WHEN len(f) > 64 THEN list_transform(range(0, len(f), greatest(1, len(f) // 64)), lambda i: f[i + 1])[1:64] ELSE f END AS f FROM x) SELECT sample_id, CAST(unnest(f) AS INTEGER) AS frame FROM y",
    "stride_sample": f"{_R} SELECT model_name, result_id FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY result_id) - 1 AS i FROM r) WHERE i % 5 = 0",
    "previous_run": f"{_R} SELECT r.model_name, r.sample_id, r.attempt, r.status, b.status AS previous_status FROM r LEFT JOIN r b ON r.model_name = b.model_name AND r.sample_id = b.sample_id AND r.attempt = b.attempt + 1",
    "average_over_ok": f"{_R} SELECT model_name, round(coalesce(avg(rtf) FILTER (status = 'ok'), 0), 6) AS mean_rtf, count(*) FILTER (rtf IS NULL) AS n_without FROM r GROUP BY ALL",
}
