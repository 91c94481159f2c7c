"""What the two ends of a live session say to each other: turns, buffers, gates, frames and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.series import running, stretch_of
from cadenza.operators.timeline import overlap_join


def implicit_turns(rows: DataFrame, key: str, order: list[str], is_delta: Column, closing: Column, size: str) -> DataFrame:
    """Turns that the first delta opens and a closing event ends: turn (from 1), opened, closed, closed_by (NULL
    while open), n_deltas, total.

    ``closing`` is the kind of an event that closes a turn, NULL for others; one that finds no open turn makes none.
    """
    cut = running(rows.withColumn("__close", closing), key, order, stretch_of(order[0]), before=True, __g=("sum", closing.isNotNull().cast("bigint")))
    cut = cut.withColumn("__g", F.coalesce("__g", F.lit(0)))
    delta, close = F.coalesce(is_delta, F.lit(False)), F.col("__close").isNotNull()
    turns = cut.groupBy(key, "__g").agg(
        F.min(F.when(delta, F.col("t"))).alias("opened"), F.max(F.when(close, F.col("t"))).alias("closed"), F.max("__close").alias("closed_by"),
        F.count_if(delta).alias("n_deltas"), F.coalesce(F.sum(F.when(delta, F.col(size))), F.lit(0)).alias("total"),
    ).filter("n_deltas > 0")
    # A row per turn is numbered, by a count over stretches of the closing numbers.
    numbered = running(turns, key, ["__g"], F.floor(F.col("__g") / 4096), turn=("sum", F.lit(1)))
    return numbered.drop("__g")


def buffered(rows: DataFrame, key: str, order: list[str], is_audio: Column, interrupt: Column, size: str) -> DataFrame:
    """Adds ``pending`` (audio that came since the last interrupt, which empties the buffer) and ``is_muted``
    (an interrupt came, and no audio since)."""
    audio = F.coalesce(is_audio, F.lit(False))
    cut = F.coalesce(interrupt, F.lit(False))
    out = running(rows, key, order, stretch_of(order[0]), __sum=("sum", F.when(audio, F.col(size)).otherwise(0)))
    out = running(out, key, order, stretch_of(order[0]), __gone=("last", F.when(cut, F.col("__sum"))), __mark=("last", F.when(cut, F.lit(True)).when(audio, F.lit(False))))
    return out.withColumn("pending", F.col("__sum") - F.coalesce("__gone", F.lit(0))).withColumn("is_muted", F.coalesce("__mark", F.lit(False))).drop("__sum", "__gone", "__mark")


def audio_first(rows: DataFrame, key: str, order: list[str], is_audio: Column, is_done: Column) -> DataFrame:
    """Adds ``may_send``: whether something other than audio may go out, which it may not from the end of a
    response until the next audio has gone."""
    mark = F.when(F.coalesce(is_done, F.lit(False)), F.lit(True)).when(F.coalesce(is_audio, F.lit(False)), F.lit(False))
    out = running(rows, key, order, stretch_of(order[0]), before=True, __shut=("last", mark))
    return out.withColumn("may_send", ~F.coalesce("__shut", F.lit(False))).drop("__shut")


def consumed_frames(rows: DataFrame, key: str, order: list[str], size: Column, is_frame: Column, source: str, frame: int) -> DataFrame:
    """Frames that each take up to ``frame`` bytes out of a first-in-first-out buffer: key, number (from 0), taken,
    source (of most of the bytes, of equals the first; NULL for silence).

    With P the bytes that came before a frame and j its number, what has been taken by then is
    N (j + 1) + min(0, min over frames so far of P - N (i + 1)): a running minimum, not a loop. Bytes of frames and
    of sources are two rows of intervals, joined in bins of a frame's size.
    """
    n = F.coalesce(F.when(~is_frame, size), F.lit(0)).cast("bigint")
    flagged = rows.withColumn("__f", is_frame).withColumn("__n", n)
    out = running(flagged, key, order, stretch_of(order[0]), __p=("sum", F.col("__n")), __j=("sum", F.col("__f").cast("bigint")))
    out = running(out, key, order, stretch_of(order[0]), __low=("max", F.when(F.col("__f"), F.col("__j") * frame - F.col("__p"))))
    taken_upto = F.col("__j") * frame - F.greatest(F.lit(0), F.coalesce("__low", F.lit(0)))
    frames = out.filter("__f").withColumn("__c", taken_upto).select(key, (F.col("__j") - 1).alias("number"), "__c")
    frames = running(frames, key, ["number"], F.floor(F.col("number") / 4096), before=True, __b=("last", F.col("__c"))).withColumn("__b", F.coalesce("__b", F.lit(0)))
    left = frames.filter("__c > __b").select(key, F.col("number").alias("l_id"), F.col("__b").cast("double").alias("l_low"), F.col("__c").cast("double").alias("l_high"))
    right = out.filter("__n > 0").select(key, F.struct((F.col("__p") - F.col("__n")).alias("at"), F.col(source).alias("source")).alias("r_id"), (F.col("__p") - F.col("__n")).cast("double").alias("r_low"), F.col("__p").cast("double").alias("r_high"))
    shared = overlap_join(left, right, key, 0.0, float(frame)).withColumn("__both", F.least("l_high", "r_high") - F.greatest("l_low", "r_low")).filter("__both > 0")
    by_source = shared.groupBy(key, "l_id", F.col("r_id.source").alias("source")).agg(F.sum("__both").alias("__both"), F.min("r_id.at").alias("at"))
    most = by_source.groupBy(key, "l_id").agg(F.max_by("source", F.struct("__both", -F.col("at"))).alias("source")).withColumnRenamed("l_id", "number")
    return frames.select(key, "number", (F.col("__c") - F.col("__b")).alias("taken")).join(most, [key, "number"], "left")


def with_texts(segments: DataFrame, texts: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """Segments with the text of their response; those without one, or with an empty one, go."""
    return segments.join(texts.select(ident, text), ident, "left").withColumn(text, F.coalesce(text, F.lit(""))).filter(F.col(text) != "")


def logical_times(chunks: DataFrame, logical: DataFrame, key: str, index: str) -> DataFrame:
    """Adds ``start`` and ``next_start`` of each chunk from a table (key, index, start, end) by its index; a chunk
    without its own row lies at [index, index + 1), the last with one ends where that one does."""
    at = logical.select(key, F.col(index), F.col("start").alias("__s"), F.col("end").alias("__e"))
    after = logical.select(key, (F.col(index) - 1).alias(index), F.col("start").alias("__n"))
    out = chunks.join(at, [key, index], "left").join(after, [key, index], "left")
    i = F.col(index).cast("double")
    start = F.coalesce("__s", i)
    return out.withColumn("start", start).withColumn("next_start", F.when(F.col("__s").isNull(), i + 1).otherwise(F.coalesce("__n", "__e"))).drop("__s", "__e", "__n")


#: Names of the timings of a chunk, and what they are called in a record.
TIMINGS = {"cost_llm_ms": "llm_ms", "cost_tts_prep_ms": "tts_prep_ms", "cost_tts_ms": "tts_ms", "cost_token2wav_ms": "token2wav_ms", "cost_all_ms": "all_ms", "wall_clock_ms": "wall_clock_ms"}
COUNTS = ("n_tokens", "n_tts_tokens", "kv_cache_length", "vision_slices", "vision_tokens")


def recorded(chunks: DataFrame, sample_rate: int = 24000) -> DataFrame:
    """One record per chunk: mode, timings under their short names to a tenth of a millisecond, counts, and for a
    chunk that speaks its text, the length of its audio and whether it ends the turn. Columns that ``chunks`` lacks
    are NULL."""
    has = set(chunks.columns)
    value = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind)
    speaks = ~F.coalesce(value("is_listen", "boolean"), F.lit(True))
    timing = F.struct(F.round(value("prefill_ms", "double"), 1).alias("prefill_ms"), *[F.round(value(c, "double"), 1).alias(n) for c, n in TIMINGS.items()], *[value(c, "bigint").alias(c) for c in COUNTS])
    samples = value("ai_audio_samples", "bigint")
    return chunks.select(
        "session_id", "index", F.round("receive_ts_ms", 1).alias("receive_ts_ms"), F.when(speaks, "SPEAK").otherwise("LISTEN").alias("mode"), timing.alias("timing"),
        F.when(speaks, F.nullif(value("text", "string"), F.lit(""))).alias("text"),
        F.when(speaks & (samples > 0), F.round(samples / sample_rate * 1000).cast("bigint")).alias("ai_audio_duration_ms"),
        (speaks & F.coalesce(value("end_of_turn", "boolean"), F.lit(False))).alias("end_of_turn"),
    )


def second_keys(*maps: DataFrame) -> DataFrame:
    """All (key, second) that any of several per-second maps has, each once, with the value of every map."""
    out = None
    for m in maps:
        names = [c for c in m.columns if c not in ("key", "second")]
        out = m.select("key", "second", *names) if out is None else out.join(m.select("key", "second", *names), ["key", "second"], "full_outer")
    return out


def audio_seconds(chunks: DataFrame, keys: list[str], samples: str, rate: int = 24000) -> DataFrame:
    """Seconds of audio of each response, from the samples of its chunks."""
    return chunks.groupBy(*keys).agg((F.sum(samples) / F.lit(rate)).alias("audio_seconds"))


def active_sessions(workers: DataFrame, now: Column) -> DataFrame:
    """Workers that hold a session, with when it was last heard of: a heartbeat, else the task's start, else now."""
    held = workers.filter(F.coalesce("session_id", F.lit("")) != "")
    return held.select("session_id", "worker_id", F.coalesce("cached_hash", F.lit("")).alias("messages_hash"), F.coalesce("last_heartbeat", "task_started_at", now).alias("last_active"))


def session_id(prefix: str = "sess") -> Column:
    """A prefix and six random letters and digits; another at every evaluation."""
    letters = "0123456789abcdefghijklmnopqrstuvwxyz"
    return F.concat(F.lit(prefix + "_"), *[F.substring(F.lit(letters), F.floor(F.rand() * 36).cast("int") + 1, F.lit(1)) for _ in range(6)])


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, without a sort: a maximum over structures."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def upserted(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A registry after a set of changes (``op`` put or delete, ``seq`` their order): the last change of a key wins,
    keys that were not changed stay, and the last change of a deleted one removes it."""
    values = [c for c in current.columns if c not in keys]
    last = last_of(changes, keys, ["seq"])
    kept = current.join(last.select(*keys), keys, "left_anti")
    return kept.select(*keys, *values).unionByName(last.filter("op = 'put'").select(*keys, *values))


def in_order(rows: DataFrame, order: list[str]) -> Column:
    """The place of a row among a few rows of a report."""
    return F.row_number().over(Window.partitionBy().orderBy(*order))
