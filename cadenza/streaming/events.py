"""The event operators over streams: windows under a watermark, sessions with explicit ends, late rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the bound on files per trigger is the back-pressure."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "5 seconds") -> DataFrame:
    """Count and sum per user and window; rows later than ``late`` behind the newest are dropped."""
    return stream.withWatermark("ts", late).groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("window_start"), "n", "total")


def sliding(stream: DataFrame, width: str = "4 hours", hop: str = "1 hour", late: str = "5 seconds") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, hop).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value") * F.col("value")).alias("mean_square")).select(F.col("w.start").alias("window_start"), "n", "mean_square")


def once_per_event(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events delivered again within the watermark are dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


SESSION = "user_id bigint, turn bigint, n bigint, seconds double, is_complete boolean"
#: A session that gets nothing for so long, by the time of the events, is flushed.
IDLE_S = 60


def _sessions(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    turn, n, seconds = state.get if state.exists else (0, 0, 0.0)
    columns = ["user_id", "turn", "n", "seconds", "is_complete"]
    if state.hasTimedOut:
        # The number of the turn stays, so that what comes later opens the next one.
        state.update((turn + 1 if n else turn, 0, 0.0))
        if n:
            yield pd.DataFrame([(key[0], turn, n, seconds, False)], columns=columns)
        return
    out = []
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for kind, value in zip(rows["event_type"], rows["value"], strict=True):
        n, seconds = n + 1, seconds + float(value)
        if kind == "purchase":
            out.append((key[0], turn, n, seconds, True))
            turn, n, seconds = turn + 1, 0, 0.0
    state.update((turn, n, seconds))
    idle_from = int(rows["ts"].max().timestamp() * 1000) + IDLE_S * 1000
    state.setTimeoutTimestamp(max(idle_from, state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame(out, columns=columns)


def response_sessions(stream: DataFrame, late: str = "5 seconds") -> DataFrame:
    """Sessions that a purchase closes, with the open one as the only state of a user; one that stands still
    for IDLE_S, once the watermark has passed that, is flushed as incomplete. The timers run on event time:
    with a processing-time timer a query over what is available would ask for another batch for ever.
    Rows of a user must arrive in order of time across triggers."""
    timed = stream.select("user_id", "event_id", "ts", "event_type", "value").withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(_sessions, SESSION, "turn bigint, n bigint, seconds double", "append", GroupStateTimeout.EventTimeTimeout)


def _after_interrupt(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    spoken, cut = state.get if state.exists else (-1, -1)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    out = []
    for ident, kind, group in zip(rows["event_id"], rows["event_type"], rows["grp"], strict=True):
        if kind == "error":
            cut = spoken
            continue
        if group != cut:
            out.append((ident, int(group)))
        spoken = int(group)
    state.update((spoken, cut))
    yield pd.DataFrame(out, columns=["event_id", "grp"])


def without_interrupted(stream: DataFrame) -> DataFrame:
    """Rows less those of the group that an interrupt cut off; state is two numbers a user."""
    return stream.select("user_id", "event_id", "ts", "event_type", "grp").groupBy("user_id").applyInPandasWithState(_after_interrupt, "event_id bigint, grp bigint", "spoken bigint, cut bigint", "append", GroupStateTimeout.NoTimeout)


def stateful(stream: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], dict], step: Callable[[dict, tuple], list[tuple]], output: str) -> DataFrame:
    """Rows of a key in order, one at a time, against a small state: ``step(state, row)`` changes the state and gives
    the rows that come out, each (key, ...) as in ``output``. The state is kept as JSON; rows of a key must arrive in
    order across triggers."""
    names = [x.split()[0].strip("`") for x in output.split(",")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else start()
        out = []
        for row in pd.concat(list(batches)).sort_values(order)[columns].itertuples(index=False, name=None):
            out += [(k[0], *made) for made in step(held, row)]
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=names)

    return stream.select(*dict.fromkeys([key, *order, *columns])).groupBy(key).applyInPandasWithState(run, output, "held string", "append", GroupStateTimeout.NoTimeout)


def implicit_turns(stream: DataFrame) -> DataFrame:
    """Turns that the first click or signup opens and a purchase or an error closes; an open one comes out when it is
    closed. (user_id, turn, n_deltas, closed_by)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        (kind,) = row
        if kind in ("click", "signup"):
            s["turn"] += s["n"] == 0
            s["n"] += 1
        elif kind in ("purchase", "error") and s["n"]:
            n, s["n"] = s["n"], 0
            return [(s["turn"], n, "complete" if kind == "purchase" else "interrupted")]
        return []

    return stateful(stream, "user_id", ["ts", "event_id"], ["event_type"], lambda: {"turn": 0, "n": 0}, step, "user_id bigint, turn bigint, n_deltas bigint, closed_by string")


def interrupted_buffer(stream: DataFrame) -> DataFrame:
    """After each event what a buffer of audio holds, which an interrupt empties and mutes until the next audio.
    (user_id, event_id, pending, is_muted); rows have a size ``k``."""

    def step(s: dict, row: tuple) -> list[tuple]:
        ident, kind, k = row
        if kind == "click":
            s["pending"], s["muted"] = s["pending"] + int(k), False
        elif kind == "error":
            s["pending"], s["muted"] = 0, True
        return [(int(ident), s["pending"], s["muted"])]

    return stateful(stream, "user_id", ["ts", "event_id"], ["event_id", "event_type", "k"], lambda: {"pending": 0, "muted": False}, step, "user_id bigint, event_id bigint, pending bigint, is_muted boolean")


def audio_gate(stream: DataFrame) -> DataFrame:
    """Views that may go out: none from a purchase until the next click. (user_id, event_id, may_send)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        ident, kind = row
        if kind in ("purchase", "click"):
            s["shut"] = kind == "purchase"
        return [(int(ident), not s["shut"])] if kind == "view" else []

    return stateful(stream, "user_id", ["ts", "event_id"], ["event_id", "event_type"], lambda: {"shut": False}, step, "user_id bigint, event_id bigint, may_send boolean")


def frame_fifo(stream: DataFrame, frame: int) -> DataFrame:
    """Frames that take up to ``frame`` bytes from the front of a buffer: (user_id, number, taken, source), the source
    of most of the bytes, of equals the first, NULL for silence. Rows have a size ``k`` and a source ``rid``."""

    def step(s: dict, row: tuple) -> list[tuple]:
        kind, k, rid = row
        if kind == "click":
            if k > 0:
                s["held"].append([int(k), rid])
            return []
        taken: dict[str, int] = {}
        room = frame
        while room and s["held"]:
            part = min(room, s["held"][0][0])
            taken[s["held"][0][1]] = taken.get(s["held"][0][1], 0) + part
            room -= part
            s["held"][0][0] -= part
            if not s["held"][0][0]:
                s["held"].pop(0)
        s["number"] += 1
        return [(s["number"] - 1, frame - room, max(taken, key=taken.get) if taken else None)]

    kinds = stream.filter("event_type IN ('click', 'view')")
    return stateful(kinds, "user_id", ["ts", "event_id"], ["event_type", "k", "rid"], lambda: {"held": [], "number": 0}, step, "user_id bigint, number bigint, taken bigint, source string")


def voice_segments(stream: DataFrame, threshold: float = 0.5, release: float = 0.15, window: int = 512, min_silence: int = 12_800, min_speech: int = 2_048) -> DataFrame:
    """Stretches of speech out of probabilities, a window of samples each: (user_id, start, end) in samples.

    Speech begins at ``threshold`` and ends once the probability has been ``release`` below it for ``min_silence``;
    what is shorter than ``min_speech`` is no speech. Rows have a probability ``p``.
    """

    def step(s: dict, row: tuple) -> list[tuple]:
        (p,) = row
        out = []
        if p >= threshold and s["start"] is None:
            s["start"], s["quiet"] = s["at"], None
        if s["start"] is not None:
            if p < threshold - release:
                s["quiet"] = s["at"] if s["quiet"] is None else s["quiet"]
                if s["at"] - s["quiet"] + window >= min_silence:
                    if s["at"] - s["start"] >= min_speech:
                        out.append((s["start"], s["at"] + window))
                    s["start"] = s["quiet"] = None
            else:
                s["quiet"] = None
        s["at"] += window
        return out

    return stateful(stream, "user_id", ["ts", "event_id"], ["p"], lambda: {"at": 0, "start": None, "quiet": None}, step, "user_id bigint, start bigint, `end` bigint")


def paced(stream: DataFrame, path: str, checkpoint: str, seconds: float) -> StreamingQuery:
    """A stream written at the pace of real time: a batch every ``seconds``, of what one trigger may read. The caller
    stops it."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()


def _finish(query: StreamingQuery, seconds: int) -> None:
    """Wait for the end of a query over what is available; one that does not end is stopped and an error."""
    try:
        if not query.awaitTermination(seconds):
            raise TimeoutError(f"the stream {query.name or query.id} did not end within {seconds} s")
    finally:
        query.stop()


def run_available(stream: DataFrame, name: str, mode: str = "append", seconds: int = 600) -> DataFrame:
    """Everything there is, once, into a table in memory: for tests and small results."""
    _finish(stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start(), seconds)
    return stream.sparkSession.table(name)


def append_batches(stream: DataFrame, path: str, checkpoint: str, seconds: int = 86_400) -> None:
    """A stream appended to JSON lines, batch by batch, from where the last run stopped."""
    writer = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("append").json(path))
    _finish(writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), seconds)
