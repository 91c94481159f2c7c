from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cadenza.operators import series as S
from cadenza.plans import protocol as PL
from cadenza.plans.series import response_sessions
from cadenza.sources import files
from cadenza.streaming import events as E
from tests.compare import DATA


def test_manifest_shapes(spark, tmp_path):
    items = [{"sample_id": "a", "n": 1}, {"sample_id": "b", "n": 2}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, items)) + "\n\n")
    (tmp_path / "b.json").write_text(json.dumps(items))
    (tmp_path / "c.json").write_text(json.dumps({"items": items}))
    for name in ("a.jsonl", "b.json", "c.json"):
        assert sorted(r["sample_id"] for r in files.manifest(spark, str(tmp_path / name), "sample_id string, n int").collect()) == ["a", "b"]
    (tmp_path / "d.json").write_text('{"other": 1}')
    with pytest.raises(Exception, match="neither"):
        files.manifest(spark, str(tmp_path / "d.json"), "sample_id string, n int").collect()


def test_batch_summary(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"total": 3, "results": [{"video": "a", "status": "ok"}, {"video": "b"}, {"video": "c", "status": "error"}]}))
    assert sorted(r["video"] for r in files.batch_summary(spark, str(tmp_path / "s.json")).collect()) == ["a", "b"]
    assert files.batch_summary(spark, str(tmp_path / "s.json"), keep_all=True).count() == 3


def test_questions_and_conversations(spark):
    rows = spark.createDataFrame([("1:00", "70", "q", "a", " RealTime ", "yes"), ("x", "1", None, None, None, None), ("5", "6", None, None, " ", None)], files.QUESTION)
    out = [tuple(r) for r in files.questions(rows).orderBy("q", "a").collect()]
    assert out == [(5, 6, "", "", "unknown", False), (60, 70, "q", "a", "realtime", True)]
    schema = "inferred_knowledge string, question_time string, question_text string, conversations array<struct<`from`:string,timestamp:string,value:string,interrupted:string>>, answers array<struct<answer_time:string,answer_text:string,interrupted:string,is_interrupted:string>>"
    talk = [("user", "5", "How?", None), ("assistant", "30", "b", None), ("assistant", "12", "a", "true")]
    rows = spark.createDataFrame([("know", None, None, talk, None), ("know", "7", "Why?", None, [("9", "c", None, "1")])], schema)
    out = [(r["q"], r["question_text"], r["a"], r["answer_text"], r["is_interrupted"]) for r in files.conversation_answers(rows).orderBy("a", "position").collect()]
    assert out == [(7, "Why?", 9, "c", True), (5, "know\n\nHow?", 12, "a", True), (5, "know\n\nHow?", 30, "b", False)]


def test_answers_keep_their_document(spark):
    rows = spark.createDataFrame([("d1", "1:00", "70", "q", "a", None, None), ("d2", "5", "6", None, None, " ", None)], "doc string, " + files.QUESTION)
    assert sorted((r["doc"], r["q"]) for r in files.questions(rows, ("doc",)).collect()) == [("d1", 60), ("d2", 5)]


def test_documents_logs_and_caches(spark, tmp_path):
    files.write_document({"名": [1]}, str(tmp_path / "a" / "b.json"))
    assert json.loads((tmp_path / "a" / "b.json").read_text(encoding="utf-8")) == {"名": [1]}
    for i in range(4):
        files.append_rolling([f"line {i}" * 5], str(tmp_path / "log"), 70)
    assert (tmp_path / "log.1").exists() and len((tmp_path / "log").read_text().splitlines()) + len((tmp_path / "log.1").read_text().splitlines()) <= 4
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, x string")
    calls = []

    def judge(misses):
        calls.append(sorted(r["k"] for r in misses.collect()))
        return misses.withColumn("verdict", F.when(F.col("k") != 3, F.col("k") / 10))

    path = str(tmp_path / "cache")
    for _ in range(2):
        got = files.cached_verdicts(spark, path, ["k"], asked, judge)
    assert calls == [[1, 2, 3], [3]] and sorted((r["k"], r["verdict"]) for r in got.collect() if r["verdict"]) == [(1, 0.1), (2, 0.2)]
    files.cached_verdicts(spark, path, ["k"], asked, judge, refresh=True)
    assert calls[-1] == [1, 2, 3]
    report = files.markdown_report("R", ("T", asked, ["k", "x"], ["k"]))
    assert report.splitlines()[:5] == ["# R", "", "## T", "", "| k | x |"]


def test_publish_report_log_presets(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    files.publish(df, str(tmp_path / "out"))
    files.publish(df.limit(1), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    files.write_report(df, str(tmp_path / "csv"), ["b"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["b"]
    files.append_log(df, str(tmp_path / "log"))
    files.append_log(df, str(tmp_path / "log"))
    assert files.json_lines(spark, str(tmp_path / "log"), "a int, b string").count() == 4
    assert [r["line"] for r in files.markdown_lines(df, ["a", "b"], ["a"]).orderBy("position").collect()] == ["| a | b |", "|---|---|", "| 1 | x |", "| 2 | y |"]
    assert (tmp_path / "out" / ".done").exists() and not (tmp_path / "out.old").exists()
    (tmp_path / "p.yaml").write_text("# a preset\nname: 'P'  # said\norder: 2\nnested:\n  name: other\n")
    (tmp_path / "q.yml").write_text("name: Q\n")
    assert [(r["preset_id"], r["order"]) for r in files.presets(spark, str(tmp_path)).collect()] == [("p", 2), ("q", 999)]
    sizes = files.folder_sizes(files.listing(spark, str(tmp_path), "*.y*ml"))
    assert sizes.count() == 1


@pytest.fixture(scope="module")
def stream_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.mode("overwrite").parquet(folder)
    return folder


def test_stream_equals_batch(spark, stream_folder):
    e = spark.read.parquet(stream_folder)
    windows = E.run_available(E.tumbling(E.read_events(spark, stream_folder)), "tumbling", "complete")
    batch = e.groupBy("user_id", F.window("ts", "1 hour").start.alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted((r["user_id"], r["window_start"], r["n"]) for r in windows.collect()) == sorted(tuple(r) for r in batch.collect())
    assert E.run_available(E.sliding(E.read_events(spark, stream_folder)), "sliding", "complete").agg(F.sum("n")).first()[0] == 4 * e.count()
    assert E.run_available(E.once_per_event(E.read_events(spark, stream_folder)), "once").count() == e.select("event_id").distinct().count()


def test_stateful_equals_batch(spark, stream_folder):
    got = E.run_available(E.response_sessions(E.read_events(spark, stream_folder)), "sessions")
    batch = response_sessions(spark, DATA).filter("is_complete")
    assert sorted((r["user_id"], r["turn"], r["n"]) for r in got.filter("is_complete").collect()) == sorted((r["user_id"], r["turn"], r["n"]) for r in batch.collect())
    grouped = lambda df: df.withColumn("grp", F.floor(F.get_json_object("props", "$.k").cast("int") / 25))
    got = E.run_available(E.without_interrupted(grouped(E.read_events(spark, stream_folder))), "cut")
    rows = grouped(spark.read.parquet(stream_folder)).withColumn("t", F.unix_micros("ts") / F.lit(1e6))
    batch = S.dropped_after_interrupt(rows, "user_id", ["t", "event_id"], F.col("event_type") == "error", "grp")
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in batch.collect())


def _rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_protocol_streams_equal_batch(spark, stream_folder):
    source = lambda: E.read_events(spark, stream_folder).withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("rid", F.concat(F.lit("r"), F.floor(F.col("k") / 25).cast("string")))
    turns = E.run_available(E.implicit_turns(source()), "turns")
    batch = PL.implicit_turns(spark, DATA).filter("closed_by IS NOT NULL")
    assert _rows_of(turns, "user_id", "turn", "n_deltas", "closed_by") == _rows_of(batch, "user_id", "turn", "n_deltas", "closed_by")
    assert _rows_of(E.run_available(E.interrupted_buffer(source()), "buffer"), "event_id", "pending", "is_muted") == _rows_of(PL.interrupted_buffer(spark, DATA), "event_id", "pending", "is_muted")
    assert _rows_of(E.run_available(E.audio_gate(source()), "gate"), "event_id", "may_send") == _rows_of(PL.audio_gate(spark, DATA), "event_id", "may_send")
    fifo = lambda df: sorted((r["user_id"], r["number"], r["taken"], r["source"] or "") for r in df.collect())
    assert fifo(E.run_available(E.frame_fifo(source(), 40), "fifo")) == fifo(PL.frame_fifo(spark, DATA))


def test_voice_segments_of_a_stream(spark, tmp_path):
    p = [0.1, 0.6, 0.9, 0.4, 0.9, 0.2, 0.2, 0.1, 0.7, 0.2, 0.2, 0.2, 0.9]
    rows = spark.createDataFrame([(i, 1, float(v)) for i, v in enumerate(p)], "event_id bigint, user_id bigint, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id"))).withColumn("event_type", F.lit("view")).withColumn("props", F.lit("{}"))
    rows.select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.read_events(spark, str(tmp_path / "in")).withColumn("p", F.col("value"))
    got = E.run_available(E.voice_segments(stream, window=10, min_silence=30, min_speech=20), "voice")
    assert _rows_of(got, "start", "end") == [(10, 80), (80, 120)]


def test_a_stream_that_does_not_end_is_an_error(spark, stream_folder):
    query = E.read_events(spark, stream_folder).writeStream.format("noop").trigger(processingTime="1 second").start()
    with pytest.raises(TimeoutError):
        E._finish(query, 1)
    assert not query.isActive
