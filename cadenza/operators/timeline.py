"""Response windows (slots) and timed utterances (chunks): building, matching, splitting, scoring."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import clamp, clean_label, decay, is_time
from cadenza.operators.series import running
from cadenza.session import long_rows
from cadenza.sources.tables import once

#: Seconds of media time in one bin of an interval join.
BIN_S = 300.0
TAIL_S = 60.0
#: Bytes of text in the first part of a sample and scene; part k has 2k + 1 times as many.
PART = 8192


def clean_slots(spark: SparkSession, folder: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Slots with all three times, each once, endpoints in order: slot_start, t_a, slot_end and ``columns``."""
    rows = once(spark, folder, "slots", ["sample_id", "slot_id", "start", "t_a", "end", *columns])
    rows = rows.filter(is_time("start") & is_time("end") & is_time("t_a"))
    return rows.select("slot_uid", "sample_id", "slot_id", F.least("start", "end").alias("slot_start"), "t_a", F.greatest("start", "end").alias("slot_end"), *columns)


def clean_chunks(spark: SparkSession, folder: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Chunks with both times, each once, endpoints in order: chunk_start, chunk_end and ``columns``."""
    rows = once(spark, folder, "chunks", ["start", "end", *columns]).filter(is_time("start") & is_time("end"))
    return rows.select("model_name", "sample_id", "chunk_id", F.least("start", "end").alias("chunk_start"), F.greatest("start", "end").alias("chunk_end"), *columns)


def _bin(x: str, width: float) -> Column:
    return F.floor(F.col(x) / F.lit(width))


def match_chunks(chunks: DataFrame, slots: DataFrame, bin_s: float = BIN_S, slot_columns: tuple[str, ...] = ()) -> DataFrame:
    """Each chunk with the innermost slot that holds its start; slot columns NULL where none does.

    An interval join on (sample, bin of media time): the sample with a third of all rows is spread over
    its bins. All candidates of a chunk share its bin, so choosing among them needs no further shuffle.
    """
    binned = slots.select("sample_id", F.explode(F.sequence(_bin("slot_start", bin_s), _bin("slot_end", bin_s))).alias("__bin"), "slot_id", "slot_start", "t_a", "slot_end", *slot_columns)
    points = chunks.withColumn("__bin", _bin("chunk_start", bin_s))
    inside = (F.col("c.sample_id") == F.col("s.sample_id")) & (F.col("c.__bin") == F.col("s.__bin")) & (F.col("chunk_start") >= F.col("slot_start")) & (F.col("chunk_start") < F.col("slot_end"))
    joined = points.alias("c").join(binned.alias("s"), inside, "left").select("c.*", "slot_id", "slot_start", "t_a", "slot_end", *slot_columns)
    best = Window.partitionBy("sample_id", "__bin", "model_name", "chunk_id").orderBy(F.col("slot_start").desc_nulls_last(), F.col("slot_id").desc_nulls_last())
    return joined.withColumn("__rn", F.row_number().over(best)).filter("__rn = 1").drop("__rn", "__bin")


def with_phase(matched: DataFrame) -> DataFrame:
    """phase (early, core; NULL unmatched), is_cross (runs over t_a), is_spill (runs past the slot)."""
    in_slot = F.col("slot_id").isNotNull()
    return (
        matched.withColumn("phase", F.when(in_slot, F.when(F.col("chunk_start") < F.col("t_a"), "early").otherwise("core")))
        .withColumn("is_cross", F.coalesce((F.col("chunk_start") < F.col("t_a")) & (F.col("t_a") < F.col("chunk_end")), F.lit(False)))
        .withColumn("is_spill", F.coalesce(F.col("chunk_end") > F.col("slot_end"), F.lit(False)))
    )


def phase_counts(phased: DataFrame) -> DataFrame:
    """Counts per model and slot; map-side partial sums, so a busy slot costs a row per task."""
    count = lambda c: F.count_if(c).alias
    return (
        phased.filter("slot_id IS NOT NULL")
        .groupBy("model_name", "sample_id", "slot_id")
        .agg(
            F.count(F.lit(1)).alias("num_chunks"),
            count(F.col("phase") == "early")("num_early"),
            count(F.col("phase") == "core")("num_core"),
            count(F.col("is_spill"))("num_spill"),
            count(F.col("is_cross"))("num_cross"),
        )
    )


def slot_texts(phased: DataFrame) -> DataFrame:
    """The text spoken in each phase of each slot, chunks in order of time, without separator, trimmed.

    The text of a slot is the result itself, so its chunks have to meet; slots are bounded by media time.
    """
    piece = F.struct("chunk_start", "chunk_end", "chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = lambda phase: F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("phase") == phase, piece))), lambda x: x["text"]), ""), r"(?U)^\s+|\s+$", "")
    return phased.filter("slot_id IS NOT NULL").groupBy("model_name", "sample_id", "slot_id").agg(joined("early").alias("text_early"), joined("core").alias("text_core"))


def split_at_answer(phased: DataFrame) -> DataFrame:
    """Rows (model, sample, chunk_id, part, text, part_start, part_end): chunks that run over t_a cut in two
    between their words. Without words the whole chunk goes to its phase.

    Words join with a space, and with nothing if one of them is Chinese.
    """
    words = F.array_sort(F.filter("aligned_words", lambda w: w["start"].isNotNull() & w["end"].isNotNull()), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] < b["end"], -1).when(a["end"] > b["end"], 1).otherwise(0))

    def side(early: bool) -> Column:
        ws = F.filter("words", lambda w: (w["start"] < F.col("t_a")) if early else (w["start"] >= F.col("t_a")))
        tokens = F.filter(F.transform(ws, lambda w: w["text"]), lambda x: x != "")
        bare = F.array_join(tokens, "")
        text = F.when(bare.rlike(r"[\x{4e00}-\x{9fff}]"), bare).otherwise(F.array_join(tokens, " "))
        bounds = lambda which: F.transform(ws, lambda w: w[which])
        return F.when(F.size(ws) > 0, F.struct(F.lit("early" if early else "core").alias("part"), text.alias("text"), F.array_min(bounds("start")).alias("part_start"), F.array_max(bounds("end")).alias("part_end")))

    crossing = phased.filter("is_cross").withColumn("words", words)
    whole = F.struct(F.col("phase").alias("part"), F.coalesce("text", F.lit("")).alias("text"), F.col("chunk_start").alias("part_start"), F.col("chunk_end").alias("part_end"))
    parts = F.when(F.coalesce(F.size("words"), F.lit(0)) > 0, F.array_compact(F.array(side(True), side(False)))).otherwise(F.array(whole))
    return crossing.select("model_name", "sample_id", "chunk_id", F.explode(parts).alias("p")).select("model_name", "sample_id", "chunk_id", "p.*")


def _in_order(questions: DataFrame, order: list[str], following: str) -> DataFrame:
    """Questions with their ``place`` in a sample, from 1, in the order of some numbers, and ``next``: ``following`` of the
    question after. Both run along stretches of media time, so a sample is no single task."""
    back = [f"__{c}" for c in order]
    rows = questions.withColumns({b: -F.col(c) for b, c in zip(back, order, strict=True)})
    placed = running(rows, "sample_id", order, F.floor(F.col(order[0]) / BIN_S), place=("sum", F.lit(1)))
    out = running(placed, "sample_id", back, F.floor(F.col(back[0]) / BIN_S), before=True, __next=("last", F.struct(F.col(following).alias("v"))))
    return out.withColumn("place", F.col("place").cast("int")).withColumn("next", F.col("__next.v")).drop("__next", *back)


def multi_turn_slots(questions: DataFrame, tail: float = TAIL_S) -> DataFrame:
    """(sample_id, q, a) rows to slots [q, a, end): a slot ends at the next question, the last ``tail`` after its answer."""
    rows = _in_order(questions, ["q", "a", "slot_uid"], "q")
    end = F.greatest(F.coalesce("next", F.col("a") + tail), F.col("q"))
    return rows.select("sample_id", "slot_uid", F.col("place").alias("ordinal"), F.col("q").alias("slot_start"), F.col("a").alias("t_a"), end.alias("slot_end"))


def stepwise_slots(questions: DataFrame, tail: float = TAIL_S) -> DataFrame:
    """One question, many answers: the first step starts at the question, a later one at its own answer."""
    first = questions.groupBy("sample_id").agg(F.min("q").alias("first_q"))
    rows = _in_order(questions, ["a", "slot_uid"], "a").join(first, "sample_id")
    rows = rows.withColumn("slot_start", F.when(F.col("place") == 1, F.col("first_q")).otherwise(F.col("a")))
    end = F.greatest(F.coalesce("next", F.col("a") + tail), F.col("slot_start"))
    return rows.select("sample_id", "slot_uid", F.col("place").alias("step"), "slot_start", F.col("a").alias("t_a"), end.alias("slot_end"))


def nested_slots(questions: DataFrame, tail: float = TAIL_S) -> DataFrame:
    """Pairs of an outer question and the first one nested in it, found greedily in order of time.

    Rows (sample_id, group, role, slot_start, t_a, slot_end). Questions between an outer one and its inner
    one are passed over; an outer one without inner ends its sample's pairs. The scan reads rows in
    order and holds two of them, whatever the sample's size.
    """
    fields = "sample_id string, pair int, outer_q double, outer_a double, inner_q double, inner_a double"
    schema = pa.schema([("sample_id", pa.string()), ("pair", pa.int32()), *((c, pa.float64()) for c in ("outer_q", "outer_a", "inner_q", "inner_a"))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, outer, pair = None, None, 0
        for batch in batches:
            out = []
            for s, q, a in zip(*(batch.column(c).to_pylist() for c in ("sample_id", "q", "a")), strict=True):
                if s != sample:
                    sample, outer, pair = s, (q, a), 0
                elif outer is None:
                    outer = (q, a)
                elif outer[0] < q < outer[1] and a <= outer[1]:
                    pair += 1
                    out.append({"sample_id": s, "pair": pair, "outer_q": outer[0], "outer_a": outer[1], "inner_q": q, "inner_a": a})
                    outer = None
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = questions.select("sample_id", "q", "a", "slot_uid").repartition("sample_id").sortWithinPartitions("sample_id", "q", "a", "slot_uid")
    pairs = rows.mapInArrow(scan, fields)
    order = Window.partitionBy("sample_id").orderBy("pair")
    pairs = pairs.withColumn("outer_end", F.greatest(F.coalesce(F.lead("outer_q").over(order), F.col("outer_a") + tail), F.col("outer_a")))
    row = lambda role, s, a, e: F.struct(F.lit(role).alias("role"), F.col(s).alias("slot_start"), F.col(a).alias("t_a"), F.col(e).alias("slot_end"))
    both = F.explode(F.array(row("outer", "outer_q", "outer_a", "outer_end"), row("inner", "inner_q", "inner_a", "outer_a")))
    return pairs.select("sample_id", "pair", both.alias("x")).select("sample_id", "pair", "x.*")


def containment_pairs(intervals: DataFrame, bin_s: float = BIN_S) -> DataFrame:
    """For each interval (sample_id, id, low, high) the first other one that lies inside it, by (low, id).

    The inner interval's start selects the bin; an outer one is present in every bin it covers.
    """
    outer = intervals.select(F.col("sample_id"), F.col("id").alias("outer_id"), F.col("low").alias("o_low"), F.col("high").alias("o_high"), F.explode(F.sequence(_bin("low", bin_s), _bin("high", bin_s))).alias("__bin"))
    inner = intervals.select("sample_id", F.col("id").alias("inner_id"), "low", "high", _bin("low", bin_s).alias("__bin"))
    held = (F.col("low") > F.col("o_low")) & (F.col("low") < F.col("o_high")) & (F.col("high") <= F.col("o_high"))
    return outer.join(inner, ["sample_id", "__bin"]).filter(held).groupBy("sample_id", "outer_id").agg(F.min_by("inner_id", F.struct("low", "inner_id")).alias("inner_id"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, tolerance: float, bin_s: float = 30.0) -> DataFrame:
    """All pairs of intervals (key, l_id, l_low, l_high) and (key, r_id, r_low, r_high) of a key that overlap
    or come within ``tolerance``. A pair is made in the one bin where its overlap begins."""
    low = lambda c: F.floor((F.col(c) - tolerance) / bin_s)
    high = lambda c: F.floor((F.col(c) + tolerance) / bin_s)
    a = left.withColumn("__bin", F.explode(F.sequence(low("l_low"), high("l_high"))))
    b = right.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("r_low") / bin_s), F.floor(F.col("r_high") / bin_s))))
    touch = (F.col("l_high") >= F.col("r_low") - tolerance) & (F.col("l_low") <= F.col("r_high") + tolerance)
    first = F.floor(F.greatest(F.col("l_low") - tolerance, F.col("r_low")) / bin_s)
    return a.join(b, [key, "__bin"]).filter(touch & (F.col("__bin") == first)).drop("__bin")


def asof_backward(events: DataFrame, states: DataFrame, key: str, value: str, stretch_s: float = BIN_S) -> DataFrame:
    """Each event (key, event_id, t) with ``value`` of the last state (key, t, value) at or before it.

    Union, a sort per stretch of time of a key, and a running last value that is carried from stretch to
    stretch: no pair of rows is ever formed, and a key is spread over its stretches.
    """
    left = events.select(key, "t", F.col("event_id"), F.lit(None).cast(states.schema[value].dataType).alias(value), F.lit(1).alias("side"))
    right = states.select(key, "t", F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), value, F.lit(0).alias("side"))
    both = running(left.unionByName(right).withColumn("__v", F.col(value)), key, ["t", "side", "__v"], F.floor(F.col("t") / stretch_s), **{"__last": ("last", F.col("__v"))})
    return both.filter("side = 1").select(key, "event_id", "t", F.col("__last").alias(value))


def stage_scores(phased: DataFrame, slots: DataFrame, verdicts: DataFrame, w_ack: float = 0.2, threshold: float = 0.5) -> DataFrame:
    """Credit for content and timeliness per model and slot.

    ``slots`` has a row per model and slot, with scene_type, step_index, is_interrupted, is_hard. ``verdicts``
    (model_name, sample_id, slot_id) is what a judge said: category (hallucination or neutral) and s_ack of
    the early part, s_core of the core part, and anchor, the time at which the answer proper begins if known.

    The early part is worth w_ack by how soon after the slot's start it comes, nothing where it hallucinates,
    which is a false positive; in a later step of one question it is worth nothing. The core part has the rest
    of the weight, by the verdict and by how soon after t_a the answer begins. A core part below ``threshold``
    is a false positive, one that is missing or worthless a false negative, words past the end of a hard slot
    a false positive. Interrupted slots have no core part and miss nothing.

    ``has_verdict`` is false where there is something to judge and no verdict.
    """
    key = ["model_name", "sample_id", "slot_id"]
    spoken = phased.filter("slot_id IS NOT NULL").groupBy(*key).agg(
        F.min(F.when(F.col("phase") == "early", F.col("chunk_start"))).alias("first_early"),
        F.min(F.when(F.col("phase") == "core", F.col("chunk_start"))).alias("first_core"),
        F.max("chunk_end").alias("last_end"),
    )
    rows = slots.join(spoken, key, "left").join(verdicts.select(*key, "category", "s_ack", "s_core", "anchor"), key, "left")
    later_step = (F.col("scene_type") == "1qna") & (F.coalesce("step_index", "slot_id", F.lit(1)) > 1)
    rows = rows.withColumn("w_ack", F.when(F.coalesce(later_step, F.lit(False)), 0.0).otherwise(F.lit(w_ack)))
    early, core = F.col("first_early").isNotNull(), F.col("first_core").isNotNull() & ~F.col("is_interrupted")
    neutral = early & (F.col("category") == "neutral")
    ack = F.when(neutral, decay("first_early", "slot_start", "t_a") * F.col("s_ack") * F.col("w_ack")).otherwise(F.lit(0.0))
    begins = F.greatest(F.coalesce(F.when(F.col("s_core") > 0, F.col("anchor")), F.greatest("first_core", "t_a")), F.col("t_a"))
    good = core & (F.col("s_core") >= threshold)
    rows = rows.withColumn("score_ack", F.coalesce(ack, F.lit(0.0))).withColumn("begins", F.when(core, begins)).withColumn("score_core", F.coalesce(F.when(good, decay("begins", "t_a", "slot_end") * F.col("s_core") * (1 - F.col("w_ack"))), F.lit(0.0)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return (
        rows.withColumn("tp", clamp(F.col("score_ack") + F.col("score_core")))
        .withColumn("fp", flag(early & (F.col("category") == "hallucination")) + flag(core & (F.col("s_core") < threshold)) + flag((F.col("last_end") > F.col("slot_end")) & F.col("is_hard")))
        .withColumn("fn", F.when(F.col("is_interrupted"), 0).otherwise((F.col("score_core") <= 0).cast("int")))
        .withColumn("has_verdict", ~((early & F.col("category").isNull()) | (core & F.col("s_core").isNull())))
        .select(*key, "slot_start", "score_ack", "score_core", "begins", "tp", "fp", "fn", "has_verdict")
    )


def until_failure(scored: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Per model and sample the slots before the first without a verdict, in order of time: status (ok, failed),
    failed_slot_id, n_slots, tp, fp, fn. Chunks in no slot are false positives of a run that is ok.

    The place of the failure is a minimum, so a sample of any size needs no sorted pass in one task.
    """
    run = ["model_name", "sample_id"]
    failed = scored.filter(~F.col("has_verdict")).groupBy(*run).agg(F.min(F.struct("slot_start", "slot_id")).alias("failed"))
    known = scored.join(failed, run, "left").withColumn("counts", F.col("failed").isNull() | (F.struct("slot_start", "slot_id") < F.col("failed")))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("counts"), F.col(c))), F.lit(0))
    sums = known.groupBy(*run).agg(F.first("failed").alias("failed"), F.count_if("counts").alias("n_slots"), F.round(total("tp"), 6).alias("tp"), total("fp").alias("fp"), total("fn").alias("fn"))
    loose = unmatched.groupBy(*run).agg(F.count(F.lit(1)).alias("n_unmatched"))
    out = sums.join(loose, run, "left").withColumn("n_unmatched", F.when(F.col("failed").isNull(), F.coalesce("n_unmatched", F.lit(0))).otherwise(F.lit(0)))
    return out.select(*run, F.when(F.col("failed").isNull(), "ok").otherwise("failed").alias("status"), F.col("failed.slot_id").alias("failed_slot_id"), "n_slots", "tp", (F.col("fp") + F.col("n_unmatched")).cast("bigint").alias("fp"), F.col("fn").cast("bigint").alias("fn"))


def full_context(stage: DataFrame, chunks: DataFrame) -> DataFrame:
    """The text around a stage of each slot: the whole texts of all chunks it has parts of, each once, in order
    of time, joined without separator. Where none of them has a text, that of the parts themselves.

    ``stage`` has model_name, sample_id, slot_id, chunk_id, text, part_start, part_end; ``chunks`` has
    model_name, sample_id, chunk_id, chunk_start, chunk_end, text. A slot's text is the result, so its chunks
    have to meet; slots are bounded by media time.
    """
    uid = ["model_name", "sample_id", "chunk_id"]
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    parts = stage.select(*uid, "slot_id", F.struct("part_start", "part_end", "chunk_id", trimmed("text").alias("text")).alias("part"))
    whole = chunks.select(*uid, F.struct("chunk_start", "chunk_end", "chunk_id", trimmed("text").alias("text")).alias("whole"))
    met = parts.join(whole, uid, "left").groupBy("model_name", "sample_id", "slot_id").agg(F.array_sort(F.collect_set("whole")).alias("w"), F.array_sort(F.collect_list("part")).alias("p"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), "")
    return met.select("model_name", "sample_id", "slot_id", trimmed(F.coalesce(F.nullif(joined("w"), F.lit("")), joined("p"))).alias("context"))


def effective_boundary(interrupted: Column, boundary: Column) -> Column:
    """Hard for interrupted slots; otherwise Soft only if the boundary says so."""
    return F.when(interrupted, "Hard").when(clean_label(boundary) == "soft", "Soft").otherwise("Hard")


def later_answers(slots: DataFrame) -> DataFrame:
    """For each slot, the lines of all later slots of its sample and scene, in order of time; "(none)" for
    the last. The result is as large as all pairs of the slots of a sample and scene.

    The lines of a sample and scene, joined, are one text, and what a slot gets is the end of it, from its own
    line's end on. The text is cut into parts that are spread over tasks, so one sample may hold many slots. Each
    part gets the text from its begin on, once: parts grow along the text, so that of a text of n bytes there are
    sqrt(n / PART), and what is moved stays near the input while rows are made of it that are far larger. Slots
    get that text by a join, which makes one row at a time: an explode would hold the texts of all of them at once.
    """
    long_rows(slots.sparkSession)
    line = F.format_string("- slot %d: %s", F.col("slot_id"), F.coalesce("gt_answer", F.lit("")))
    keyed = slots.select(F.struct("sample_id", "scene_type").alias("__g"), "slot_start", "slot_id", "slot_uid", line.alias("line"))
    keyed = keyed.withColumn("size", F.octet_length("line") + 1)
    # Numbers that can't be NULL: else a filter comes into one branch of a join, and what both share is shuffled twice.
    whole_number = lambda c: F.coalesce(F.floor(c), F.lit(0))
    placed = running(keyed, "__g", ["slot_start", "slot_id", "slot_uid"], whole_number(F.col("slot_start") / BIN_S), end=("sum", F.col("size")))
    placed = placed.withColumn("begin", F.col("end") - F.col("size")).withColumn("part", whole_number(F.sqrt(F.col("begin") / PART)))
    parts = placed.groupBy("__g", "part").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "slot_id", "line"))).alias("rows"))
    onward = Window.partitionBy("__g").orderBy("part").rowsBetween(0, Window.unboundedFollowing)
    texts = parts.select("__g", "part", F.col("rows")[0]["begin"].alias("part_begin"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))
    texts = texts.select("__g", "part", "part_begin", F.array_join(F.collect_list("text").over(onward), "\n").cast("binary").alias("text"))
    each = parts.select("__g", "part", F.explode(F.transform("rows", lambda r: F.struct(r["slot_id"].alias("slot_id"), r["end"].alias("end")))).alias("r")).select("__g", "part", "r.slot_id", "r.end")
    skip = (F.col("end") - F.col("part_begin")).cast("int")
    later = F.when(skip < F.octet_length("text"), F.substr("text", skip + 1).cast("string")).otherwise("(none)")
    return each.join(texts.hint("merge"), ["__g", "part"]).select(F.col("__g.sample_id").alias("sample_id"), "slot_id", later.alias("later"))
