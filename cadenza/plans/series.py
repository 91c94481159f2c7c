"""Event series: queries over ``events`` (a user is a session) and ``lineitem``, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import micros_to_seconds
from cadenza.operators import series as S
from cadenza.plans import Query
from cadenza.sources.tables import table

ORDER = ["t", "event_id"]


def _events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select("event_id", "user_id", "event_type", "value", micros_to_seconds("ts").alias("t"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def _label(e: DataFrame) -> DataFrame:
    """The response an event belongs to, NULL for errors (silence)."""
    return e.withColumn("label", F.when(F.col("event_type") != "error", F.concat(F.lit("r"), (F.col("k") % 2).cast("string"))))


def speak_islands(spark: SparkSession, folder: str) -> DataFrame:
    return S.speaking_islands(_events(spark, folder), "user_id", ORDER, F.col("event_type") != "error")


def touching_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Shipped lines of an order as segments by line number: neighbours touch."""
    li = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("low"), (F.col("l_linenumber") + 1).alias("high")).distinct()
    return S.merged_touching(li, "l_orderkey", "low", "high")


def rle_segments(spark: SparkSession, folder: str) -> DataFrame:
    return S.run_lengths(_label(_events(spark, folder)), "user_id", ORDER, "label")


def bridge_segments(spark: SparkSession, folder: str) -> DataFrame:
    return S.bridged_runs(_label(_events(spark, folder)), "user_id", ORDER, "label")


def proportional_times(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    out = S.proportional_times(li, "l_orderkey", "l_linenumber", F.greatest("q", F.lit(1.0)), F.lit(60.0), digits=6)
    return out.select("l_orderkey", "l_linenumber", "start", "end")


def turn_index(spark: SparkSession, folder: str) -> DataFrame:
    out = S.turn_index(_events(spark, folder), "user_id", ORDER, F.col("event_type") == "purchase")
    return out.groupBy("user_id", "turn").agg(F.count(F.lit(1)).alias("n"))


def logical_timeline(spark: SparkSession, folder: str) -> DataFrame:
    out = S.laid_end_to_end(_events(spark, folder), "user_id", ORDER, F.greatest(F.col("k") * 1000, F.lit(16000)).cast("bigint"))
    return out.select("event_id", "offset", "end_offset")


def subtitles(spark: SparkSession, folder: str) -> DataFrame:
    turns = S.turn_index(_events(spark, folder), "user_id", ORDER, F.col("event_type") == "purchase")
    return S.subtitles(turns, "user_id", ORDER, "event_type", 1.5).select("event_id", "line", F.round("shown_from", 3).alias("shown_from"), F.round("shown_to", 3).alias("shown_to"))


def steady_subtitles(spark: SparkSession, folder: str) -> DataFrame:
    """A line that the next one only extends stays until that begins, else its own time."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    e = _events(spark, folder).withColumn("line", F.concat("event_type", F.when(F.col("k") % 2 == 0, "").otherwise("!")))
    nxt, at = F.lead("line").over(w), F.lead("t").over(w)
    return e.select("event_id", F.round(F.when(nxt.startswith(F.col("line")), at).otherwise(F.col("t") + 1.5), 3).alias("until"))


def first_speech(spark: SparkSession, folder: str) -> DataFrame:
    return S.time_to_first(_events(spark, folder), "user_id", ORDER, F.col("event_type") != "view").select("event_id", F.round("wait", 3).alias("wait"))


def clock_drift(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).withColumn("received", F.col("t") + F.col("value"))
    return S.drift(e, "user_id", ORDER, "t", "received").select("event_id", F.round("drift", 3).alias("drift"))


def playback_gaps(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).withColumn("duration", F.col("value") * 60)
    out = S.placed_without_overlap(e, "user_id", ORDER, "t", "duration")
    return out.filter("gap > 0.01").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_gaps"), F.round(F.sum("gap"), 1).alias("gap_seconds"))


def right_placement(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).withColumn("duration", F.col("value") * 60)
    return S.placed_without_overlap(e, "user_id", ORDER, "t", "duration").select("event_id", (F.round(F.col("start") - F.col("t"), 2) + F.lit(0.0)).alias("pushed"))


def retention(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_chars", (-micros_to_seconds("created_at")).alias("age"), (-F.col("doc_id")).alias("place"))
    out = S.retained(docs, "source", ["age", "place"], "age", "n_chars", 20000)
    return out.groupBy("source").agg(F.count_if("kept").alias("n_kept"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("n_chars"))), F.lit(0)).alias("chars_kept"), F.count_if(~F.col("kept")).alias("n_gone"))


def ema(spark: SparkSession, folder: str) -> DataFrame:
    return S.moving_average(_events(spark, folder).select("event_id", "event_type", "t", "value"), "event_type", ORDER, "value").select("event_id", F.round("ema", 6).alias("ema"))


def queue_eta(spark: SparkSession, folder: str) -> DataFrame:
    """When each event's job starts, a pool of two workers to a user."""
    e = _events(spark, folder).select("event_id", "user_id", "t", "value")
    return S.queue_times(e, "user_id", ORDER, 2, "value").select("event_id", F.round("starts_at", 4).alias("starts_at"))


def kv_window(spark: SparkSession, folder: str) -> DataFrame:
    """What is held after each event, if above 400 the oldest go until 200 is met."""
    e = _events(spark, folder).select("event_id", "user_id", "t", F.col("k").cast("double").alias("size"))
    return S.water_marks(e, "user_id", ORDER, "size", 400.0, 200.0).select("event_id", "held")


def kv_context(spark: SparkSession, folder: str) -> DataFrame:
    return S.last_units(_events(spark, folder), "user_id", [F.col("t").desc(), F.col("event_id").desc()], 24).select("user_id", "event_id")


def warm_up(spark: SparkSession, folder: str) -> DataFrame:
    """All but the first three rows of each session."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    return _events(spark, folder).withColumn("i", F.row_number().over(w)).filter("i > 3").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def time_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return S.buckets(_events(spark, folder), ["user_id"], F.floor(F.col("t") / 86400), ORDER)


def sliding_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Loudness over overlapping blocks of four hours every hour."""
    e = table(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = S.blocks(e, "at", "4 hours", "1 hour").groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value") * F.col("value")).alias("ms"))
    return out.select((F.unix_micros("block.start") / 1000000).cast("bigint").alias("block_start"), "n", F.round(-0.691 + 10 * F.log10(F.col("ms") + 1e-30), 5).alias("loudness"))


def interrupt_drop(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).withColumn("grp", F.floor(F.col("k") / 25))
    return S.dropped_after_interrupt(e, "user_id", ORDER, F.col("event_type") == "error", "grp").select("event_id", "grp")


def dominant_mode(spark: SparkSession, folder: str) -> DataFrame:
    return S.dominant(_events(spark, folder), ["user_id"], "event_type", ORDER)


def session_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).filter("value > 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 6).alias("min"), F.round(F.max("value"), 6).alias("max"), F.round(F.avg("value"), 4).alias("avg"))


def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """Latest report per user; one that was given work keeps it, whatever an idle report says."""
    e = _events(spark, folder)
    g = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("t", "event_id")).alias("reported"), F.max_by(F.when(F.col("event_type") != "view", F.col("event_type")), F.when(F.col("event_type") != "view", F.struct("t", "event_id"))).alias("given"))
    return g.select("user_id", F.when((F.col("reported") == "view") & F.col("given").isNotNull(), F.col("given")).otherwise(F.col("reported")).alias("state"))


def running_left(spark: SparkSession, folder: str) -> DataFrame:
    """Time left of running jobs, never below 0, and the countdown that only falls while the place is the same."""
    w = Window.partitionBy("user_id", "place").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    e = _events(spark, folder).withColumn("place", F.floor(F.col("t") / 864000)).withColumn("left", F.greatest(F.col("value") - F.col("k"), F.lit(0.0)))
    return e.select("event_id", F.round("left", 6).alias("left"), F.round(F.min("left").over(w), 6).alias("countdown"))


def response_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with explicit ends: a purchase closes, what follows opens the next; open ones are flushed."""
    turns = S.turn_index(_events(spark, folder), "user_id", ORDER, F.col("event_type") == "purchase")
    return turns.groupBy("user_id", "turn").agg(F.round(F.min("t"), 3).alias("opened"), F.round(F.max("t"), 3).alias("closed"), F.count(F.lit(1)).alias("n"), F.max(F.col("event_type") == "purchase").alias("is_complete"), F.round(F.sum("value"), 6).alias("seconds"))


def translated(spark: SparkSession, folder: str) -> DataFrame:
    """Events of one protocol in the words of another, payloads redacted to their length."""
    kind = F.when(F.col("event_type") == "view", "session.created").when(F.col("event_type").isin("click", "signup"), "response.delta").when(F.col("event_type") == "purchase", "response.done").otherwise("error")
    return table(spark, folder, "events").select("event_id", kind.alias("type"), F.concat(F.lit("<"), F.length(F.base64(F.encode("props", "UTF-8"))).cast("string"), F.lit(" b64 chars>")).alias("payload"))


def probe_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """A tick every day of a session's time: how many each session gets."""
    span = _events(spark, folder).groupBy("user_id").agg((F.max("t") - F.min("t")).alias("s"))
    return span.select("user_id", F.size(F.sequence(F.lit(0), F.floor(F.col("s") / 86400).cast("int"))).alias("n_ticks"))


def frame_clock(spark: SparkSession, folder: str) -> DataFrame:
    """Frames to the first tick at or after them, of a fixed clock of 30 ms, by arithmetic."""
    return _events(spark, folder).select("event_id", F.ceil(F.round(F.col("value") / 0.03, 6)).cast("bigint").alias("tick"), (F.col("event_id") % 30 == 0).alias("is_kept"))


def expiries(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that stand still for longer than a day time out: how often, and the longest pause."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    e = _events(spark, folder).withColumn("pause", F.col("t") - F.lag("t").over(w))
    return e.groupBy("user_id").agg(F.count_if(F.col("pause") > 86400).alias("n_timeouts"), F.round(F.max("pause"), 3).alias("longest"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (speak_islands, touching_segments, rle_segments, bridge_segments, proportional_times, turn_index, logical_timeline, subtitles, steady_subtitles, first_speech, clock_drift, playback_gaps, right_placement, retention, ema, queue_eta, kv_window, kv_context, warm_up, time_buckets, sliding_blocks, interrupt_drop, dominant_mode, session_summary, latest_state, running_left, response_sessions, translated, probe_ticks, frame_clock, expiries)
}
_E = "WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t, CAST(props->>'$.k' AS INTEGER) AS k FROM events)"
_W = "(PARTITION BY user_id ORDER BY t, event_id)"
_TURN = ", tr AS (SELECT *, coalesce(sum(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM e)"
_LABEL = ", l0 AS (SELECT *, CASE WHEN event_type <> 'error' THEN 'r' || (k % 2) END AS label FROM e)"
_RUN = f", x AS (SELECT *, lag(label) OVER {_W} IS DISTINCT FROM label OR row_number() OVER {_W} = 1 AS nw FROM l1), y AS (SELECT *, sum(CAST(nw AS INTEGER)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, label, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM y WHERE label IS NOT NULL GROUP BY user_id, g, label"
_PLACED = f", d AS (SELECT *, value * 60 AS du, sum(value * 60) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e), m AS (SELECT *, max(t - (s - du)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS ld FROM d), z AS (SELECT *, s + ld AS en, s + ld - du AS st FROM m)"
_LI = "SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY ALL"
ORACLES = {
    "speak_islands": _E + ", x AS (SELECT *, sum(CAST(event_type = 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM x WHERE event_type <> 'error' GROUP BY user_id, g",
    "touching_segments": "WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber AS low, l_linenumber + 1 AS high FROM lineitem), x AS (SELECT *, CAST(lag(high) OVER (PARTITION BY l_orderkey ORDER BY low) IS DISTINCT FROM low AS INTEGER) AS nw FROM s), y AS (SELECT *, sum(nw) OVER (PARTITION BY l_orderkey ORDER BY low ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT l_orderkey, min(low) AS low, max(high) AS high, count(*) AS n FROM y GROUP BY l_orderkey, g",
    "rle_segments": _E + _LABEL + ", l1 AS (SELECT * FROM l0)" + _RUN,
    "bridge_segments": _E + _LABEL + ", l1 AS (SELECT * FROM l0 WHERE label IS NOT NULL)" + _RUN,
    "proportional_times": f"""WITH l AS ({_LI}), x AS (SELECT l_orderkey, l_linenumber, greatest(q, 1.0) AS w, sum(greatest(q, 1.0)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS u, sum(greatest(q, 1.0)) OVER (PARTITION BY l_orderkey) AS tot, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nx FROM l)
SELECT l_orderkey, l_linenumber, round(60.0::DOUBLE * (u - w) / tot, 6) AS start, round(CASE WHEN nx IS NULL THEN 60.0::DOUBLE ELSE 60.0::DOUBLE * u / tot END, 6) AS "end" FROM x""",
    "turn_index": _E + _TURN + " SELECT user_id, CAST(turn AS BIGINT) AS turn, count(*) AS n FROM tr GROUP BY ALL",
    "logical_timeline": _E + ", x AS (SELECT event_id, CAST(greatest(k * 1000, 16000) AS BIGINT) AS n, CAST(sum(greatest(k * 1000, 16000)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS en FROM e) SELECT event_id, en - n AS \"offset\", en AS end_offset FROM x",
    "subtitles": _E + _TURN + " SELECT event_id, string_agg(event_type, ' ') OVER (PARTITION BY user_id, turn ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS line, round(t, 3) AS shown_from, round(coalesce(lead(t) OVER (PARTITION BY user_id, turn ORDER BY t, event_id), t + 1.5), 3) AS shown_to FROM tr",
    "steady_subtitles": _E + f", x AS (SELECT *, event_type || CASE WHEN k % 2 = 0 THEN '' ELSE '!' END AS line FROM e) SELECT event_id, round(CASE WHEN starts_with(lead(line) OVER {_W}, line) THEN lead(t) OVER {_W} ELSE t + 1.5 END, 3) AS until FROM x",
    "first_speech": _E + f", x AS (SELECT *, event_type <> 'view' AS s, lag(event_type <> 'view') OVER {_W} AS b, last_value(CASE WHEN event_type = 'view' THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM e) SELECT event_id, round(t - h, 3) AS wait FROM x WHERE s AND b = false",
    "clock_drift": _E + ", x AS (SELECT *, t + value AS rc FROM e) SELECT event_id, round(rc - t - first_value(rc - t) OVER (PARTITION BY user_id ORDER BY t, event_id), 3) AS drift FROM x",
    "playback_gaps": _E + _PLACED + f", g AS (SELECT user_id, greatest(st - lag(en) OVER {_W}, 0) AS gap FROM z) SELECT user_id, count(*) AS n_gaps, round(sum(gap), 1) AS gap_seconds FROM g WHERE gap > 0.01 GROUP BY user_id",
    "right_placement": _E + _PLACED + " SELECT event_id, round(st - t, 2) + 0.0 AS pushed FROM z",
    "retention": "WITH x AS (SELECT coalesce(source, '') AS source, n_chars, sum(n_chars) OVER (PARTITION BY coalesce(source, '') ORDER BY created_at DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) <= 20000 AS kept FROM documents) SELECT source, count(*) FILTER (kept) AS n_kept, CAST(coalesce(sum(n_chars) FILTER (kept), 0) AS BIGINT) AS chars_kept, count(*) FILTER (NOT kept) AS n_gone FROM x GROUP BY source",
    "ema": _E + ", o AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS i FROM e), r AS (SELECT event_id, event_type, i, value AS ema FROM o WHERE i = 1 UNION ALL SELECT o.event_id, o.event_type, o.i, 0.3::DOUBLE * o.value + 0.7::DOUBLE * r.ema FROM r JOIN o ON o.event_type = r.event_type AND o.i = r.i + 1) SELECT event_id, round(ema, 6) AS ema FROM r",
    "queue_eta": _E + """, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e), q AS (SELECT user_id, i, event_id, 0.0::DOUBLE AS at0, 0.0::DOUBLE AS a, value AS b FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, o.event_id, q.a, least(q.b, q.a + o.value), greatest(q.b, q.a + o.value) FROM q JOIN o ON o.user_id = q.user_id AND o.i = q.i + 1) SELECT event_id, round(at0, 4) AS starts_at FROM q""",
    "kv_window": _E + """, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e), q AS (SELECT user_id, i, event_id, [k] AS h FROM o WHERE i = 1
  UNION ALL SELECT user_id, i, event_id, CASE WHEN list_sum(h) > 400 THEN h[list_min(list_filter(range(1, len(h) + 1), lambda d: list_sum(h) - list_sum(h[1:d]) <= 200)) + 1:] ELSE h END FROM (SELECT o.user_id, o.i, o.event_id, list_append(q.h, o.k) AS h FROM q JOIN o ON o.user_id = q.user_id AND o.i = q.i + 1)) SELECT event_id, CAST(coalesce(list_sum(h), 0) AS DOUBLE) AS held FROM q""",
    "kv_context": _E + " SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS rn FROM e) WHERE rn <= 24",
    "warm_up": _E + f" SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER {_W} AS i FROM e) WHERE i > 3 GROUP BY user_id",
    "time_buckets": _E + " SELECT user_id, CAST(floor(t / 86400) AS BIGINT) AS bucket, count(*) AS n, round(sum(value), 6) AS total, string_agg(event_type, ' ' ORDER BY t, event_id) AS labels, arg_min(event_type, (t, event_id)) AS first_label FROM e GROUP BY ALL",
    "sliding_blocks": _E + ", b AS (SELECT value, unnest(range(CAST(floor(t / 3600) AS BIGINT) - 3, CAST(floor(t / 3600) AS BIGINT) + 1)) * 3600 AS block_start FROM e) SELECT block_start, count(*) AS n, round(-0.691 + 10 * log10(avg(value * value) + 1e-30), 5) AS loudness FROM b GROUP BY block_start",
    "interrupt_drop": _E + """, x AS (SELECT *, CAST(floor(k / 25.0) AS BIGINT) AS grp FROM e), y AS (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN grp END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spoken FROM x),
z AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN coalesce(spoken, -1) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cut FROM y)
SELECT event_id, grp FROM z WHERE event_type <> 'error' AND NOT coalesce(cut = grp, false)""",
    "dominant_mode": _E + ", c AS (SELECT user_id, event_type, count(*) AS n, min((t, event_id)) AS f FROM e GROUP BY ALL) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1",
    "session_summary": _E + " SELECT user_id, count(*) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 4) AS avg FROM e WHERE value > 0 GROUP BY user_id",
    "latest_state": _E + ", g AS (SELECT user_id, arg_max(event_type, (t, event_id)) AS rp, arg_max(event_type, (t, event_id)) FILTER (event_type <> 'view') AS gv FROM e GROUP BY user_id) SELECT user_id, CASE WHEN rp = 'view' AND gv IS NOT NULL THEN gv ELSE rp END AS state FROM g",
    "running_left": _E + ", x AS (SELECT *, floor(t / 864000) AS place, greatest(value - k, 0) AS lf FROM e) SELECT event_id, round(lf, 6) AS \"left\", round(min(lf) OVER (PARTITION BY user_id, place ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 6) AS countdown FROM x",
    "response_sessions": _E + _TURN + " SELECT user_id, CAST(turn AS BIGINT) AS turn, round(min(t), 3) AS opened, round(max(t), 3) AS closed, count(*) AS n, bool_or(event_type = 'purchase') AS is_complete, round(sum(value), 6) AS seconds FROM tr GROUP BY ALL",
    "translated": "SELECT event_id, CASE WHEN event_type = 'view' THEN 'session.created' WHEN event_type IN ('click', 'signup') THEN 'response.delta' WHEN event_type = 'purchase' THEN 'response.done' ELSE 'error' END AS type, '<' || length(base64(encode(props))) || ' b64 chars>' AS payload FROM events",
    "probe_ticks": _E + " SELECT user_id, CAST(floor((max(t) - min(t)) / 86400) AS INTEGER) + 1 AS n_ticks FROM e GROUP BY user_id",
    "frame_clock": _E + " SELECT event_id, CAST(ceil(round(value / 0.03, 6)) AS BIGINT) AS tick, event_id % 30 = 0 AS is_kept FROM e",
    "expiries": _E + f", x AS (SELECT user_id, t - lag(t) OVER {_W} AS p FROM e) SELECT user_id, count(*) FILTER (p > 86400) AS n_timeouts, round(max(p), 3) AS longest FROM x GROUP BY user_id",
}
