"""Queues, clips and phrase times: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import dispatch as D
from cadenza.plans import Query
from cadenza.plans.series import _E, _events
from cadenza.sources.tables import once


def fifo_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """When each event's job starts in its user's pool, two workers and three places to wait; NULL if refused."""
    jobs = _events(spark, folder).withColumn("seconds", F.col("value") * 6000).select("event_id", "user_id", "t", "seconds")
    out = D.first_in_first_out(jobs, "user_id", ["t", "event_id"], "t", "seconds", 2, 3)
    return out.select("event_id", F.round("starts_at", 2).alias("starts_at"))


def waiting_estimate(spark: SparkSession, folder: str) -> DataFrame:
    left = F.array(F.when(F.col("k") % 3 != 0, F.col("k").cast("double")), F.when(F.col("k") % 5 != 0, F.lit(20.0)))
    return _events(spark, folder).select("event_id", D.waiting_estimate(left, F.col("k") % 4 + 1).alias("wait"))


def clips(spark: SparkSession, folder: str) -> DataFrame:
    m = once(spark, folder, "sample_manifest", ["video_duration_sec"]).filter("video_duration_sec IS NOT NULL")
    return m.select("sample_id", F.explode(D.clip_bounds(F.col("video_duration_sec"))).alias("c")).select("sample_id", "c.part", F.round("c.start", 3).alias("start"), F.round("c.end", 3).alias("end"))


def phrase_times(spark: SparkSession, folder: str) -> DataFrame:
    """When the second word of a chunk is heard, found by its text."""
    c = once(spark, folder, "chunks", ["start", "aligned_words"]).filter("size(aligned_words) >= 2")
    return c.select("model_name", "sample_id", "chunk_id", D.time_of_phrase(F.col("aligned_words"), F.element_at("aligned_words", 2)["text"], F.col("start")).alias("at"))


def token_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Input and output of every run, by model: sums of sums."""
    r = once(spark, folder, "batch_result", ["model_name", "num_chunks", "num_responses"])
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return r.groupBy("model_name").agg(n("num_chunks").alias("n_in"), n("num_responses").alias("n_out"), (n("num_chunks") + n("num_responses")).alias("n_total"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (fifo_dispatch, waiting_estimate, clips, phrase_times, token_totals)}
ORACLES = {
    "fifo_dispatch": _E + """, o AS (SELECT *, value * 6000 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e), q AS (SELECT user_id, i, event_id, t AS at0, 0.0::DOUBLE AS a, t + sec AS b, []::DOUBLE[] AS w FROM o WHERE i = 1
  UNION ALL SELECT user_id, i, event_id, CASE WHEN no THEN NULL ELSE st END, CASE WHEN no THEN a ELSE least(b, st + sec) END, CASE WHEN no THEN b ELSE greatest(b, st + sec) END, CASE WHEN no OR st <= t THEN w ELSE list_append(w, st) END
  FROM (SELECT *, a > t AND len(w) >= 3 AS no, greatest(t, a) AS st FROM (SELECT o.*, q.a, q.b, list_filter(q.w, lambda x: x > o.t) AS w FROM q JOIN o ON o.user_id = q.user_id AND o.i = q.i + 1)))
SELECT event_id, round(at0, 2) AS starts_at FROM q""",
    "phrase_times": """WITH c AS (SELECT DISTINCT ON (model_name, sample_id, chunk_id) * FROM chunks WHERE len(aligned_words) >= 2), w AS (SELECT model_name, sample_id, chunk_id, start AS s0, regexp_replace(aligned_words[2].text, '^["''“”‘’]+|["''“”‘’]+$', '', 'g') AS ph, lower(list_aggregate(list_transform(aligned_words, lambda x: coalesce(x.text, '')), 'string_agg', '')) AS j, unnest(range(1, len(aligned_words) + 1)) AS i, unnest(aligned_words) AS w FROM c),
o AS (SELECT *, instr(j, lower(ph)) AS pos, coalesce(sum(length(coalesce(w.text, ''))) OVER (PARTITION BY model_name, sample_id, chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS off FROM w)
SELECT model_name, sample_id, chunk_id, coalesce(arg_max(w.start, i) FILTER (pos > 0 AND off <= pos AND w.start IS NOT NULL AND length(w.text) > 0), any_value(s0)) AS "at" FROM o GROUP BY ALL""",
    "waiting_estimate": _E + ", x AS (SELECT event_id, k, list_filter([CASE WHEN k % 3 <> 0 THEN CAST(k AS DOUBLE) END, CASE WHEN k % 5 <> 0 THEN 20.0::DOUBLE END], lambda v: v IS NOT NULL) AS l FROM e) SELECT event_id, greatest(1.0::DOUBLE, round(coalesce(list_avg(l), 15.0::DOUBLE) + (k % 4) * 15.0::DOUBLE)) AS wait FROM x",
    "clips": "WITH m AS (SELECT DISTINCT sample_id, video_duration_sec AS d FROM sample_manifest WHERE video_duration_sec IS NOT NULL) SELECT sample_id, 'first' AS part, 0.0::DOUBLE AS start, round(least(d, 60.0::DOUBLE), 3) AS \"end\" FROM m UNION ALL SELECT sample_id, 'last', round(greatest(0, d - 60), 3), round(d, 3) FROM m",
    "token_totals": "WITH r AS (SELECT DISTINCT ON (result_id) * FROM batch_result) SELECT model_name, CAST(coalesce(sum(num_chunks), 0) AS BIGINT) AS n_in, CAST(coalesce(sum(num_responses), 0) AS BIGINT) AS n_out, CAST(coalesce(sum(num_chunks), 0) + coalesce(sum(num_responses), 0) AS BIGINT) AS n_total FROM r GROUP BY model_name",
}
