"""Live sessions: queries over ``events`` (a user is a session) and the runs, and their SQL.

A click is audio of k bytes, a signup a piece of text, a purchase the end of a response, an error an
interruption, a view a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import protocol as R
from cadenza.operators import series as S
from cadenza.plans import Query
from cadenza.plans.series import _E, _LABEL, _RUN, ORDER, _events, _label
from cadenza.sources.tables import once, table

AUDIO, DONE, CUT = "click", "purchase", "error"


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def implicit_turns(spark: SparkSession, folder: str) -> DataFrame:
    closing = F.when(_is(DONE), "complete").when(_is(CUT), "interrupted")
    out = R.implicit_turns(_events(spark, folder), "user_id", ORDER, F.col("event_type").isin("click", "signup"), closing, "k")
    return out.select("user_id", "turn", F.round("opened", 3).alias("opened"), F.round("closed", 3).alias("closed"), "closed_by", "n_deltas", "total")


def interrupted_buffer(spark: SparkSession, folder: str) -> DataFrame:
    return R.buffered(_events(spark, folder), "user_id", ORDER, _is(AUDIO), _is(CUT), "k").select("event_id", "pending", "is_muted")


def audio_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Frames that may go out: none between the end of a response and the next audio."""
    return R.audio_first(_events(spark, folder), "user_id", ORDER, _is(AUDIO), _is(DONE)).filter("event_type = 'view'").select("event_id", "may_send")


def frame_fifo(spark: SparkSession, folder: str) -> DataFrame:
    """Audio taken out frame by frame, 40 bytes each, with the response most of it came from."""
    e = _events(spark, folder).filter("event_type IN ('click', 'view')").withColumn("rid", F.concat(F.lit("r"), F.floor(F.col("k") / 25).cast("string")))
    return R.consumed_frames(e, "user_id", ORDER, F.col("k"), F.expr("event_type = 'view'"), "rid", 40)


def response_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of a response with its text; one without text is left out."""
    runs = S.run_lengths(_label(_events(spark, folder)), "user_id", ORDER, "label")
    texts = spark.createDataFrame([("r0", "first words"), ("r9", "never heard"), ("r2", "")], "label string, text string")
    return R.with_texts(runs, texts, "label").select("user_id", "label", F.round("first_t", 3).alias("first_t"), "n", "text")


def chunk_times(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a model as chunks with an index; even models have logical times of their own for some."""
    r = once(spark, folder, "batch_result", ["model_name", "num_chunks"]).select(F.col("model_name").alias("key"), (F.col("result_id") % 5000).cast("bigint").alias("i"), "num_chunks")
    r = r.groupBy("key", "i").agg(F.max("num_chunks").alias("n"))
    logical = r.filter("n IS NOT NULL").select("key", "i", (F.col("i") * 2.0).alias("start"), (F.col("i") * 2.0 + 1.5).alias("end"))
    return R.logical_times(r, logical, "key", "i").select("key", "i", "start", "next_start")


def recorded_chunks(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("index"), (F.col("value") * 100 / 3).alias("receive_ts_ms"), (F.col("event_type") == "view").alias("is_listen"), (F.col("value") * 0.318309).alias("prefill_ms"), (F.col("value") * 0.707107).alias("cost_llm_ms"),
        F.col("k").alias("n_tokens"), F.when(F.col("k") % 4 == 0, "").otherwise(F.col("event_type")).alias("text"), (F.col("k") * 960).alias("ai_audio_samples"), (F.col("event_type") == "purchase").alias("end_of_turn"),
    )
    out = R.recorded(e)
    return out.select("session_id", "index", "receive_ts_ms", "mode", F.col("timing.prefill_ms").alias("prefill_ms"), F.col("timing.llm_ms").alias("llm_ms"), F.col("timing.n_tokens").alias("n_tokens"), "text", "ai_audio_duration_ms", "end_of_turn")


def second_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Per day of a session the texts joined, the audio bytes and the first language, for every day any of them has."""
    e = _events(spark, folder).withColumn("second", F.floor(F.col("t") / 86400)).withColumn("key", F.col("user_id"))
    joined = lambda kind, sep, name: e.filter(F.col("event_type") == kind).groupBy("key", "second").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", F.concat(F.lit(kind[0]), F.col("k").cast("string")).alias("x")))), lambda v: v["x"]), sep).alias(name))
    audio = e.filter("event_type = 'click'").groupBy("key", "second").agg(F.sum("k").alias("audio_bytes"))
    language = e.filter("event_type = 'purchase'").groupBy("key", "second").agg(F.min_by(F.when(F.col("k") % 2 == 0, "zh").otherwise("en"), F.struct("t", "event_id")).alias("language"))
    out = R.second_keys(joined("signup", "", "model_text"), joined("error", " ", "asr_text"), audio, language)
    return out.select(F.col("key").alias("user_id"), "second", F.coalesce("model_text", F.lit("")).alias("model_text"), F.coalesce("asr_text", F.lit("")).alias("asr_text"), F.coalesce("audio_bytes", F.lit(0)).cast("bigint").alias("audio_bytes"), "language")


def response_audio(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).filter("event_type = 'click'").withColumn("rid", F.floor(F.col("k") / 25)).withColumn("samples", F.col("k") * 240)
    return R.audio_seconds(e, ["user_id", "rid"], "samples").withColumn("audio_seconds", F.round("audio_seconds", 6))


def active_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Workers of runs that hold a session; every third was heard of, every second has a start."""
    w = once(spark, folder, "batch_result", ["sample_id", "status"]).select(
        F.when(F.col("status") != "ok", F.col("sample_id")).alias("session_id"), F.col("result_id").alias("worker_id"), F.lit(None).cast("string").alias("cached_hash"),
        F.when(F.col("result_id") % 3 == 0, F.col("finished_at")).alias("last_heartbeat"), F.when(F.col("result_id") % 2 == 0, F.col("finished_at") - F.expr("INTERVAL 1 HOUR")).alias("task_started_at"),
    )
    return R.active_sessions(w, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")).select("session_id", "worker_id", "messages_hash", F.date_format("last_active", "yyyy-MM-dd HH:mm:ss").alias("last_active"))


def session_names(spark: SparkSession, folder: str) -> DataFrame:
    """Random names of sessions: their form is all that can be compared."""
    return _events(spark, folder).select("event_id", R.session_id("live").rlike("^live_[0-9a-z]{6}$").alias("is_well_formed"))


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as a registry after the changes that suppliers make to it."""
    now = table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    s = table(spark, folder, "supplier")
    changes = s.select((F.col("s_nationkey") + (F.col("s_suppkey") % 3)).alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"), F.when(F.col("s_suppkey") % 4 == 0, "delete").otherwise("put").alias("op"))
    return R.upserted(now, changes, ["id"])


def asr_words(spark: SparkSession, folder: str) -> DataFrame:
    """The table that stands for speech recognition: timed words in order."""
    c = once(spark, folder, "chunks", ["aligned_words"]).filter("aligned_words IS NOT NULL")
    return c.select("model_name", "sample_id", "chunk_id", F.posexplode("aligned_words").alias("i", "w")).select("model_name", "sample_id", "chunk_id", "i", "w.text", "w.start", "w.end")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (implicit_turns, interrupted_buffer, audio_gate, frame_fifo, response_texts, chunk_times, recorded_chunks, second_rollup, response_audio, active_sessions, session_names, registry, asr_words)
}
_RUNNING = "OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)"
_BEFORE = "OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ORACLES = {
    "implicit_turns": _E + f""", x AS (SELECT *, coalesce(sum(CAST(event_type IN ('purchase', 'error') AS INTEGER)) {_BEFORE}, 0) AS g FROM e),
y AS (SELECT user_id, g, min(t) FILTER (event_type IN ('click', 'signup')) AS opened, max(t) FILTER (event_type IN ('purchase', 'error')) AS closed, max(CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'interrupted' END) AS closed_by, count(*) FILTER (event_type IN ('click', 'signup')) AS n_deltas, CAST(coalesce(sum(k) FILTER (event_type IN ('click', 'signup')), 0) AS BIGINT) AS total FROM x GROUP BY user_id, g)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY g) AS turn, round(opened, 3) AS opened, round(closed, 3) AS closed, closed_by, n_deltas, total FROM y WHERE n_deltas > 0""",
    "interrupted_buffer": _E + f""", x AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN k ELSE 0 END) {_RUNNING} AS s FROM e), y AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN s END IGNORE NULLS) {_RUNNING} AS gone, last_value(CASE event_type WHEN 'error' THEN true WHEN 'click' THEN false END IGNORE NULLS) {_RUNNING} AS mark FROM x)
SELECT event_id, CAST(s - coalesce(gone, 0) AS BIGINT) AS pending, coalesce(mark, false) AS is_muted FROM y""",
    "audio_gate": _E + f", x AS (SELECT *, last_value(CASE event_type WHEN 'purchase' THEN true WHEN 'click' THEN false END IGNORE NULLS) {_BEFORE} AS shut FROM e) SELECT event_id, NOT coalesce(shut, false) AS may_send FROM x WHERE event_type = 'view'",
    "frame_fifo": _E + """, o AS (SELECT *, 'r' || CAST(floor(k / 25.0) AS BIGINT) AS rid, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e WHERE event_type IN ('click', 'view')),
f AS (SELECT user_id, i, CASE WHEN event_type = 'click' THEN k ELSE 0 END AS held, CASE WHEN event_type = 'click' THEN k ELSE 0 END AS made, 0 AS took, CAST(0 AS BIGINT) AS done, CAST(event_type = 'view' AS INTEGER) AS j FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, CASE WHEN o.event_type = 'click' THEN f.held + o.k ELSE f.held - least(f.held, 40) END, f.made + CASE WHEN o.event_type = 'click' THEN o.k ELSE 0 END, CASE WHEN o.event_type = 'view' THEN least(f.held, 40) ELSE 0 END, f.done + CASE WHEN o.event_type = 'view' THEN least(f.held, 40) ELSE 0 END, f.j + CAST(o.event_type = 'view' AS INTEGER)
  FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1),
fr AS (SELECT f.user_id, j - 1 AS number, took, done - took AS a, done AS b FROM f JOIN o USING (user_id, i) WHERE event_type = 'view'),
pr AS (SELECT f.user_id, rid, made - k AS a, made AS b FROM f JOIN o USING (user_id, i) WHERE event_type = 'click' AND k > 0),
sh AS (SELECT fr.user_id, number, rid, sum(least(fr.b, pr.b) - greatest(fr.a, pr.a)) AS n, min(pr.a) AS at0 FROM fr JOIN pr ON fr.user_id = pr.user_id AND fr.a < pr.b AND pr.a < fr.b GROUP BY ALL),
ms AS (SELECT user_id, number, arg_max(rid, (n, -at0)) AS source FROM sh GROUP BY ALL)
SELECT fr.user_id, CAST(fr.number AS BIGINT) AS number, CAST(took AS BIGINT) AS taken, source FROM fr LEFT JOIN ms ON ms.user_id = fr.user_id AND ms.number = fr.number""",
    "response_texts": _E + _LABEL + ", l1 AS (SELECT * FROM l0)" + _RUN.replace(" SELECT user_id, label, min(t)", ", z AS (SELECT user_id, label, min(t)", 1) + ") SELECT user_id, label, round(first_t, 3) AS first_t, n, 'first words' AS text FROM z WHERE label = 'r0'",
    "chunk_times": """WITH r AS (SELECT model_name AS key, result_id % 5000 AS i, max(num_chunks) AS n FROM (SELECT DISTINCT ON (result_id) * FROM batch_result) GROUP BY ALL), l AS (SELECT key, i, i * 2.0::DOUBLE AS s, i * 2.0::DOUBLE + 1.5::DOUBLE AS e FROM r WHERE n IS NOT NULL)
SELECT r.key, r.i, coalesce(a.s, CAST(r.i AS DOUBLE)) AS start, CASE WHEN a.s IS NULL THEN CAST(r.i + 1 AS DOUBLE) ELSE coalesce(b.s, a.e) END AS next_start FROM r LEFT JOIN l a ON a.key = r.key AND a.i = r.i LEFT JOIN l b ON b.key = r.key AND b.i = r.i + 1""",
    "recorded_chunks": _E + " SELECT user_id AS session_id, event_id AS \"index\", round(value * 100 / 3, 1) AS receive_ts_ms, CASE WHEN event_type = 'view' THEN 'LISTEN' ELSE 'SPEAK' END AS mode, round(value * 0.318309::DOUBLE, 1) AS prefill_ms, round(value * 0.707107::DOUBLE, 1) AS llm_ms, CAST(k AS BIGINT) AS n_tokens, CASE WHEN event_type <> 'view' AND k % 4 <> 0 THEN event_type END AS text, CASE WHEN event_type <> 'view' AND k > 0 THEN CAST(k * 40 AS BIGINT) END AS ai_audio_duration_ms, event_type = 'purchase' AS end_of_turn FROM e",
    "second_rollup": _E + """, x AS (SELECT *, CAST(floor(t / 86400) AS BIGINT) AS second FROM e WHERE event_type <> 'view')
SELECT user_id, second, coalesce(string_agg('s' || k, '' ORDER BY t, event_id) FILTER (event_type = 'signup'), '') AS model_text, coalesce(string_agg('e' || k, ' ' ORDER BY t, event_id) FILTER (event_type = 'error'), '') AS asr_text, CAST(coalesce(sum(k) FILTER (event_type = 'click'), 0) AS BIGINT) AS audio_bytes, arg_min(CASE WHEN k % 2 = 0 THEN 'zh' ELSE 'en' END, (t, event_id)) FILTER (event_type = 'purchase') AS language FROM x GROUP BY ALL""",
    "response_audio": _E + " SELECT user_id, CAST(floor(k / 25.0) AS BIGINT) AS rid, round(sum(k * 240) / 24000.0::DOUBLE, 6) AS audio_seconds FROM e WHERE event_type = 'click' GROUP BY ALL",
    "active_sessions": "WITH r AS (SELECT result_id, sample_id, status, min(finished_at) AS f FROM batch_result GROUP BY ALL) SELECT sample_id AS session_id, result_id AS worker_id, '' AS messages_hash, strftime(CASE WHEN result_id % 3 = 0 THEN f WHEN result_id % 2 = 0 THEN f - INTERVAL 1 HOUR ELSE TIMESTAMP '2020-01-01 00:00:00' END, '%Y-%m-%d %H:%M:%S') AS last_active FROM r WHERE status <> 'ok'",
    "session_names": "SELECT event_id, true AS is_well_formed FROM events",
    "registry": "WITH c AS (SELECT s_nationkey + s_suppkey % 3 AS id, s_name AS name, s_suppkey AS seq, s_suppkey % 4 = 0 AS gone FROM supplier), l AS (SELECT DISTINCT ON (id) * FROM c ORDER BY id, seq DESC) SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT id FROM l) UNION ALL SELECT id, name FROM l WHERE NOT gone",
    "asr_words": 'WITH c AS (SELECT DISTINCT ON (model_name, sample_id, chunk_id) * FROM chunks WHERE aligned_words IS NOT NULL), w AS (SELECT model_name, sample_id, chunk_id, unnest(range(len(aligned_words))) AS i, unnest(aligned_words) AS w FROM c) SELECT model_name, sample_id, chunk_id, CAST(i AS INTEGER) AS i, w.text, w.start, w."end" FROM w',
}
