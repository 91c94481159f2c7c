"""Worked examples by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.functions import signal as G
from cadenza.functions import text as X
from cadenza.operators import series, timeline


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_parse_time(spark):
    texts = ["90", "1:02", "1:00:05", " 3.5 ", "", "a:b", "1:2:3:4", None]
    assert values(spark, S.parse_time("s"), [(t,) for t in texts], "s string") == [90, 62, 3605, 3.5, None, None, None, None]


def test_decay(spark):
    for gamma, expected in ((1.0, [1, 1, 0.5, 0]), (2.0, [1, 1, 0.75, 0])):
        assert values(spark, S.decay("t", F.lit(10.0), F.lit(20.0), 1.0, gamma), [(9.0,), (10.0,), (15.0,), (20.0,)], "t double") == expected
    assert values(spark, S.decay("t", F.lit(10.0), F.lit(5.0)), [(10.0,), (11.0,)], "t double") == [1, 0]


def test_ratio_and_clamp(spark):
    assert values(spark, S.safe_ratio("a", "b"), [(1.0, 0.0), (1.0, -1.0), (1.0, None), (1.0, 4.0)], "a double, b double") == [0, 0, 0, 0.25]
    assert values(spark, S.clamp("a"), [(-1.0,), (None,), (2.0,)], "a double") == [0, None, 1]


@pytest.mark.parametrize(("text", "number"), [("十", 10), ("一百二十三", 123), ("两万三千", 23000), ("一零五", 105), ("abc", None), ("", None), (None, None)])
def test_chinese_number(spark, text, number):
    got = spark.createDataFrame([(text,)], "t string").select(X.chinese_numeral("t")).first()[0]
    assert got == number


def test_spoken_prefix():
    assert X.spoken_prefix("Hello, big world!", ["hello", "big"]) == "Hello, big "
    assert X.spoken_prefix("Hello", []) == ""
    assert X.spoken_prefix("Hello", ["help"]) == "Hel"
    assert X.spoken_prefix(None, ["a"]) is None


def test_first_json():
    assert X.first_json('x {bad} {"b": {"a": 1}} {"c": 2}') == '{"b":{"a":1}}'
    assert X.first_json("none") is None and X.first_json(None) is None


def test_voice_segments():
    assert G.voice_segments([0, 0.9, 0.9, 0.4, 0.9, 0, 0, 0, 0, 0], 0.5, 0.15, 3, 1, 0) == [(1, 5)]
    assert G.voice_segments([0.9], 0.5, 0.15, 3, 2, 0) == []


def test_moving_average_and_queue(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([10.0, 20.0, 30.0])], "k string, i int, v double")
    assert [round(r["ema"], 6) for r in series.moving_average(rows, "k", ["i"], "v").orderBy("i").collect()] == [10, 13, 18.1]
    jobs = spark.createDataFrame([("a", i, v) for i, v in enumerate([15.0, 10.0, 20.0, 20.0, 20.0])], "k string, i int, v double")
    # Two workers that are busy for 15 and 10 s more: the three after them start at 10, 15 and 30 s.
    assert [r["starts_at"] for r in series.queue_times(jobs, "k", ["i"], 2, "v").orderBy("i").collect()] == [0, 0, 10, 15, 30]


def test_placement_and_retention(spark):
    rows = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 0.5, 1.0), ("a", 2, 3.0, 1.0)], "k string, i int, now double, dur double")
    out = series.placed_without_overlap(rows, "k", ["i"], "now", "dur").orderBy("i").collect()
    assert [r["start"] for r in out] == [0, 1, 3] and [r["gap"] for r in out] == [0, 0, 1]
    aged = spark.createDataFrame([("a", 100_000.0 * (3 - i), float(s)) for i, s in enumerate([5, 4, 3, 2])], "k string, age double, s double")
    assert sorted(r["s"] for r in series.retained(aged, "k", ["age"], "age", "s", 6).filter("kept").collect()) == [2, 3]


def test_running_measures_cross_stretches(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([3, None, 1, 5, None, None, 2, 4])], "k string, t int, v int")
    out = series.running(rows, "k", ["t"], F.floor(F.col("t") / 3), s=("sum", F.col("v")), m=("max", F.col("v")), last=("last", F.col("v"))).orderBy("t").collect()
    assert [(r["s"], r["m"], r["last"]) for r in out] == [(3, 3, 3), (3, 3, 3), (4, 3, 1), (9, 5, 5), (9, 5, 5), (9, 5, 5), (11, 5, 2), (15, 5, 4)]
    before = series.previous(rows, "k", ["t"], F.floor(F.col("t") / 3), was=F.col("v")).orderBy("t").collect()
    assert [r["was"] for r in before] == [None, 3, None, 1, 5, None, None, 2]
    assert series.running(rows.limit(0), "k", ["t"], F.floor(F.col("t") / 3), s=("sum", F.col("v"))).count() == 0


def test_proportional(spark):
    rows = spark.createDataFrame([("a", 0, "ab"), ("a", 1, ""), ("a", 2, "c")], "k string, i int, t string")
    out = series.proportional_times(rows, "k", "i", F.greatest(F.length("t"), F.lit(1)), F.lit(2.0)).orderBy("i").collect()
    assert [(r["start"], r["end"]) for r in out] == [(0, 1), (1, 1.5), (1.5, 2)]


def test_run_lengths_and_bridges(spark):
    rows = spark.createDataFrame([("k", i, i, x) for i, x in enumerate([None, "a", "a", None, "a", "b"])], "k string, i int, t int, x string")
    runs = lambda df: sorted((r["x"], r["first_t"], r["last_t"]) for r in df.collect())
    assert runs(series.run_lengths(rows, "k", ["i"], "x")) == [("a", 1, 2), ("a", 4, 4), ("b", 5, 5)]
    assert runs(series.bridged_runs(rows, "k", ["i"], "x")) == [("a", 1, 4), ("b", 5, 5)]


def test_nested_slots(spark):
    q = spark.createDataFrame([("s", 0.0, 30.0, 1), ("s", 10.0, 20.0, 2), ("s", 60.0, 90.0, 3), ("s", 70.0, 80.0, 4)], "sample_id string, q double, a double, slot_uid int")
    out = sorted((r["pair"], r["role"], r["slot_start"], r["t_a"], r["slot_end"]) for r in timeline.nested_slots(q).collect())
    assert out == [(1, "inner", 10, 20, 30), (1, "outer", 0, 30, 60), (2, "inner", 70, 80, 90), (2, "outer", 60, 90, 150)]


def test_split_at_answer(spark):
    words = [{"text": t, "start": a, "end": b} for t, a, b in (("let", 18.0, 19.0), ("me", 19.5, 19.9), ("two", 20.5, 21.0), ("apples", 21.0, 22.0))]
    schema = "model_name string, sample_id string, chunk_id bigint, chunk_start double, chunk_end double, t_a double, phase string, is_cross boolean, text string, aligned_words array<struct<text:string,start:double,end:double>>"
    rows = spark.createDataFrame([("m", "s", 1, 18.0, 24.0, 20.0, "early", True, "let me two apples", words), ("m", "s", 2, 18.0, 24.0, 20.0, "early", True, "whole", None)], schema)
    out = sorted((r["chunk_id"], r["part"], r["text"], r["part_start"], r["part_end"]) for r in timeline.split_at_answer(rows).collect())
    assert out == [(1, "core", "two apples", 20.5, 22), (1, "early", "let me", 18, 19.9), (2, "early", "whole", 18, 24)]
