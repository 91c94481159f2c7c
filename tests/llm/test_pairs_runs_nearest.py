from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import pairtext as P
from cadenza.llm.nearest import XFastTries, nearest_in_time
from cadenza.llm.pairs import broken_pairs
from cadenza.llm.quantiles import combine, partial_sketches, rank_error, read_percentiles
from cadenza.llm.runs import collapse_runs, nearly_same, reduce_text


# --- runs ------------------------------------------------------------------------------------------
def brute_runs(rows):
    out, by = set(), {}
    for k, i, t, *_ in rows:
        if k is not None and i is not None:
            by.setdefault(k, {})[i] = t
    for k, events in by.items():
        run = None
        for i in sorted(events):
            t = reduce_text(events[i])
            if not t:
                continue
            if run and nearly_same(run[2], t):
                run[1:] = [i, t, run[3] + 1]
            else:
                if run and run[3] > 1:
                    out.add((k, run[0], run[1], run[3]))
                run = [i, i, t, 1]
        if run and run[3] > 1:
            out.add((k, run[0], run[1], run[3]))
    return out


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("abcdefghij", "abcdefghij", True), ("abcdefghij", "abcdefghiX", True), ("abcdefghij", "abcdefgihj", True), ("abcdefghij", "bacdefghij", True), ("abcdefghij", "abcdefghijk", True), ("abcdefghi", "abcdefghX", False), ("abcdefghi1", "abcdefghi2", False), ("abcdefghij", "abcdefghXY", False), ("abcdefghij", "jbcdefghia", False), ("abcdefghijkl", "abcdefghij", False)],
)
def test_nearly_same(a, b, same):
    assert nearly_same(a, b) is same and nearly_same(b, a) is same


def test_runs_against_brute_force(spark):
    r = random.Random(5)
    texts = ["Hi!", "hi", "ｈｉ", " ", None, "the long sentence one", "the long sentense one", "the lnog sentence one", "…", "x" * 50_000]
    rows = [(r.choice("ab"), r.randrange(200), r.choice(texts), 1, "clash") for _ in range(150)]
    rows = list({(k, i): (k, i, t, b, h) for k, i, t, b, h in rows}.values())
    rows += rows[:20] + [(None, 1, "hi", 1, ""), ("a", None, "hi", 1, "")]
    df = spark.createDataFrame(rows, "k string, i bigint, t string, block int, head string")
    for block in (3, 16, 16_384):
        out = [(x["k"], x["first_id"], x["last_id"], x["n_events"]) for x in collapse_runs(df, ["k"], "i", "t", block=block).collect()]
        assert len(out) == len(set(out)) and set(out) == brute_runs(rows)


def test_run_times_and_empty(spark):
    df = spark.createDataFrame([("a", 1, "x", 1.0, 2.0), ("a", 2, "x", None, None), ("a", 3, "X", 3.0, 5.0)], "k string, i bigint, t string, s double, e double")
    row = collapse_runs(df, ["k"], "i", "t", F.col("s"), F.col("e")).first()
    assert (row["n_events"], row["start"], row["end"], row["duration"]) == (3, 1, 5, 4)
    assert collapse_runs(df.limit(0), ["k"], "i", "t").count() == 0


# --- nearest ---------------------------------------------------------------------------------------
def test_tries_give_neighbours():
    r = np.random.default_rng(1)
    entity, time = r.integers(0, 5, 300), r.integers(0, 1 << 12, 300)
    pairs = np.unique(np.stack([entity, time], 1), axis=0)
    tries = XFastTries(pairs[:, 0], pairs[:, 1], 12)
    q, t = r.integers(0, 7, 500), r.integers(0, 1 << 12, 500)
    before, after = tries.neighbours(q, t)
    for e, x, b, a in zip(q, t, before, after):
        own = pairs[pairs[:, 0] == e][:, 1]
        low, high = own[own <= x], own[own >= x]
        assert (pairs[b, 1] if b >= 0 else None) == (low.max() if len(low) else None)
        assert (pairs[a, 1] if a >= 0 else None) == (high.min() if len(high) else None)


def test_nearest_against_brute_force(spark):
    r = random.Random(2)
    cand = [(r.choice("gh"), r.choice("mn"), i, round(r.uniform(0, 3000), 2), 0) for i in range(300)]
    cand += cand[:10] + [("g", "m", 900, 7.0, 0), ("g", "m", 901, 7.0, 0), ("g", "m", 1, None, 0), (None, "m", 2, 1.0, 0), ("g", "m", 3, float("nan"), 0)]
    query = [(r.choice("ghi"), i, round(r.uniform(0, 3000), 2), "x") for i in range(200)] + [("g", 500, 5.0, "x"), ("g", 501, 9.0, "x"), ("g", 502, 9.001, "x"), ("g", 503, None, "x")]
    c = spark.createDataFrame(cand, "grp string, label string, id bigint, t double, stretch int")
    q = spark.createDataFrame(query, "grp string, qid bigint, t double, tick string")
    got = nearest_in_time(q, c, "grp", (F.lit("q"), F.col("qid"), F.col("t")), (F.col("label"), F.col("id"), F.col("t")), 2.0)
    got = {(x["query_id"], x["label"]): x["id"] for x in got.collect()}
    want = {}
    for g, i, t, _ in query:
        for label in "mn":
            near = [(abs(round(x * 1000) - round(t * 1000)), k) for gg, ll, k, x, _ in cand if t is not None and gg == g and ll == label and x is not None and x == x]
            if near and min(near)[0] <= 2000:
                want[i, label] = min(near)[1]
    assert got == want
    empty = nearest_in_time(q, c.limit(0), "grp", (F.lit("q"), F.col("qid"), F.col("t")), (F.col("label"), F.col("id"), F.col("t")), 2.0)
    assert empty.count() == 0


# --- percentiles -----------------------------------------------------------------------------------
def test_percentiles_within_bound(spark):
    df = spark.range(60_000).select(F.lit("g").alias("k"), (F.col("id") % 7).alias("day"), F.pmod(F.col("id") * 7919, F.lit(60_000)).cast("double").alias("v"), F.lit(1).alias("sketch"))
    odd = spark.createDataFrame([("g", 1, None, 1), ("g", 1, float("nan"), 1), ("h", 1, None, 1), (None, 2, 5.0, 1)], "k string, day bigint, v double, sketch int")
    parts = partial_sketches(df.unionByName(odd), ["k"], "v", {"day": F.col("day")}, k=256)
    out = {r["k"]: r for r in read_percentiles(combine(parts, ["k"], k=256), ["k"], [50, 99], k=256).collect()}
    assert set(out) == {"g", None} and out["g"]["n_values"] == 60_000 and out[None]["p50"] == 5.0
    for p in (50, 99):
        assert abs(out["g"][f"p{p}"] / 60_000 - p / 100) <= 1.5 * rank_error(256)
    assert partial_sketches(df.limit(0), ["k"], "v", {"day": F.col("day")}).count() == 0


# --- pairs -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("text", [None, "", " \n", "…", "N/A", "(no output)", "<empty>", "[silence]", "（无）", "​", "-"])
def test_empty(text):
    assert P.is_empty(text)


def test_not_empty():
    assert not P.is_empty("540") and not P.is_empty("no") and not P.is_empty("无法看到")


@pytest.mark.parametrize(
    ("question", "answer", "is_copy"),
    [
        ("Where did I leave the red hammer?", "Where did I leave the red hammer", True),
        ("Where did I leave the red hammer?", "WHERE DID I LEAVE THE RED HAMMER?", True),
        ("Where did I leave the red hammer?", "Were did I leave teh red hammer?", True),
        ("Where did I leave the red hammer?", "You asked: Where did I leave the red hammer?", True),
        ("Where did I leave the red hammer?", "Where did I leave the red hammer? Where did I leave the red hammer?", True),
        ("Where did I leave the red hammer?", "Where did I leave the red hammer? It is on the shelf.", False),
        ("Where did I leave the red hammer?", "You left the red hammer on the shelf.", False),
        ("窗台上一共有几个勺子？", "窗 台 上 一 共 有 几 个 勺 子 ？", True),
        ("窗台上一共有几个勺子？", "嗯，窗台上一共有几个勺子？", True),
        ("窗台上一共有几个勺子？", "窗台上一共有五个勺子。", False),
    ],
)
def test_question_copy(question, answer, is_copy):
    assert P.question_copy(P.plain(question), P.plain(answer)) is is_copy


@pytest.mark.parametrize(
    ("question", "answer", "other"),
    [
        ("Where is the hammer now?", "你把锤子放在窗台上了。", True),
        ("Where is the hammer now?", "Der Hammer steht jetzt neben dem Topf auf der linken Seite.", True),
        ("Where is the hammer now?", 'The sign says "请勿触摸", so leave it.', False),
        ("Where is the hammer now?", "540", False),
        ("锤子在哪里？", "好的。The hammer is on the shelf behind the plate.", True),
        ("锤子在哪里？", '英语里叫 "hammer"，就是锤子。', False),
        ("锤子在哪里？", "Okay. 锤子在窗台上。", False),
    ],
)
def test_other_language(question, answer, other):
    assert P.other_language(P.plain(question), P.plain(answer)) is other


def test_broken_pairs(spark):
    sentences = ["The red cup is on the top shelf.", "The blue cup is beside the sink.", "Put the cup beside the sink.", "I think it is on the top shelf."]
    rows = [("t", i, f"Where is thing number {i}?", sentences[i % 4], False, 0) for i in range(80)]
    rows += [("t", 100 + i, f"What about item {i}, the {w} one?", f"I'm sorry, but I cannot help with that request{e}", False, 0) for i, (w, e) in enumerate([("red", "."), ("blue", " at this time."), ("green", "."), ("old", "!"), ("new", " at this time."), ("tiny", ".")])]
    rows += [
        ("t", 200, "Where is the cup?", "The red cup is on the", False, 0), ("t", 201, "Where is the cup?", "The red cup is on the", True, 0),
        ("t", 202, "Where is the cup?", "The red cup is on the top shelf", False, 0), ("t", 203, "Where is the cup?", None, None, 0),
        ("t", 204, "Where is the cup?", "Where is the cup?", False, 0), ("t", 205, "Where is the cup?", "杯子在窗台上面的架子里。", False, 0),
        ("t", 206, None, "The red cup is on the top shelf.", False, 0), ("t", 207, "Where is the cup?", "The red cup, ", False, 0),
        ("t", 208, "Where is it?", "The red cup is on the top shelf. " * 4000, False, 0), ("t", 203, "Where is the cup?", None, None, 0),
    ]
    df = spark.createDataFrame(rows, "pair_table string, pair_id bigint, question string, answer string, interrupted boolean, clause int")
    found = [(r["pair_id"], r["defect_type"]) for r in broken_pairs(df).collect()]
    assert len(found) == len(set(found))
    assert dict(found) == {**{100 + i: "refusal" for i in range(6)}, 200: "truncated", 203: "empty", 204: "question_copy", 205: "other_language", 207: "truncated"}
    assert broken_pairs(df.limit(0)).count() == 0
