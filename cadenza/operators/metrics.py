"""Soft precision and recall, their groupings, and diagnostics of evaluated slots.

Sums and counts are kept as such until the last step; ratios with an empty denominator are 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import clean_label, f1, safe_ratio
from cadenza.sources.tables import once

COLUMNS = [
    "model_name", "sample_id", "slot_id", "scene_type", "question_type", "is_interrupted", "num_chunks", "num_early", "num_core",
    "score_ack", "score_core", "tp_n", "fp_delta", "fn_delta", "spill", "spill_seconds", "max_chunk_end", "actual_text", "diag_status", "partial_quality",
]


def evaluated(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluated slots, each once, labels cleaned, FN recomputed from the core score."""
    rows = once(spark, folder, "unified_eval", COLUMNS)
    return (
        rows.withColumn("scene_type", clean_label("scene_type"))
        .withColumn("question_type", clean_label("question_type", "unknown"))
        .withColumn("fn", F.when(F.col("is_interrupted"), 0).otherwise((F.coalesce("score_core", F.lit(0.0)) <= 0).cast("int")))
        .withColumn("role", F.coalesce(nested_role(F.col("scene_type"), F.lit(None), F.col("question_type"), F.col("slot_id")), F.lit("none")))
    )


def nested_role(scene: Column, role: Column, question_type: Column, slot_id: Column) -> Column:
    """outer or inner for slots of nested scenes: as stated, else by the type of the question, else by an odd or
    even number, else unknown. NULL for other scenes."""
    stated = clean_label(role.cast("string"))
    kind = clean_label(question_type)
    inferred = F.when(stated.isin("outer", "inner"), stated).when(kind == "proactive", "outer").when(kind == "realtime", "inner").when(slot_id % 2 == 1, "outer").when(slot_id % 2 == 0, "inner").otherwise("unknown")
    return F.when(scene == "nested", inferred)


def soft_sums() -> list[Column]:
    return [
        F.sum("tp_n").alias("tp"),
        F.sum("fp_delta").cast("bigint").alias("fp"),
        F.sum("fn").cast("bigint").alias("fn"),
        F.count(F.lit(1)).alias("n_slots"),
    ]


def finalized(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of rows with tp, fp, fn; FP and FN as whole numbers."""
    r = lambda c, name: F.round(c, 6).alias(name)
    return sums.select(*keys, "n_slots", r(F.col("tp"), "tp"), "fp", "fn", r(safe_ratio("tp", F.col("tp") + F.col("fp")), "precision"), r(safe_ratio("tp", F.col("tp") + F.col("fn")), "recall"), r(f1("tp", "fp", "fn"), "f1"))


def by_groupings(rows: DataFrame) -> DataFrame:
    """Per model: all slots, by scene, by question type, by role and the interrupted ones, in one pass over
    the rows (grouping sets share one expansion and one shuffle)."""
    sets = [["model_name"], ["model_name", "scene_type"], ["model_name", "question_type"], ["model_name", "role"], ["model_name", "is_interrupted"]]
    grouped = rows.groupingSets(sets, "model_name", "scene_type", "question_type", "role", "is_interrupted")
    sums = grouped.agg(*soft_sums(), F.grouping_id().alias("gid"))
    kind = F.when(F.col("gid") == 15, "all").when(F.col("gid") == 7, "scene_type").when(F.col("gid") == 11, "question_type").when(F.col("gid") == 13, "role").otherwise("is_interrupted")
    value = F.coalesce("scene_type", "question_type", "role", F.col("is_interrupted").cast("string"), F.lit(""))
    return finalized(sums.withColumn("grouping", kind).withColumn("value", value), ["model_name", "grouping", "value"])


def global_with_unmatched(rows: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Totals per model, unmatched chunks added to its false positives. They belong to no slot, so groups
    do not hold them: the groups' sum is less than the total by design."""
    sums = rows.groupBy("model_name").agg(*soft_sums())
    loose = unmatched.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_unmatched"))
    joined = sums.join(loose, "model_name", "left").fillna(0, ["n_unmatched"])
    return finalized(joined.withColumn("fp", F.col("fp") + F.col("n_unmatched")), ["model_name", "n_unmatched"])


def two_level(rows: DataFrame) -> DataFrame:
    """Sample summaries, then model summaries from them alone: the same as in one step, as sums are kept."""
    sample = rows.groupBy("model_name", "sample_id").agg(*soft_sums(), F.sum("score_core").alias("core_sum"), F.count("score_core").alias("core_n"))
    model = sample.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_samples"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n_slots", "core_sum", "core_n")))
    return finalized(model, ["model_name", "n_samples"]).join(model.select("model_name", F.round(safe_ratio("core_sum", "core_n"), 6).alias("mean_core")), "model_name")


def pure_scores(rows: DataFrame) -> DataFrame:
    """Mean scores over all slots and over the uninterrupted, by scene; empty means are 0."""
    free = ~F.col("is_interrupted")
    mean = lambda c, when: F.round(safe_ratio(F.sum(F.when(when, F.coalesce(c, F.lit(0.0)))), F.count_if(when)), 6)
    return rows.groupBy("model_name", "scene_type").agg(mean("score_core", F.lit(True)).alias("core_all"), mean("score_core", free).alias("core_free"), mean("score_ack", free).alias("ack_free"), mean("tp_n", free).alias("tp_free"))


def has_output(rows: DataFrame) -> Column:
    del rows
    return (F.coalesce("num_chunks", F.lit(0)) > 0) | (F.length(F.regexp_replace(F.coalesce("actual_text", F.lit("")), r"(?U)\s", "")) > 0)


def interruptions(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Interrupted slots per model: without output, quality of the rest, words past the cut."""
    cut = rows.filter("is_interrupted").withColumn("has_output", has_output(rows)).withColumn("q", F.nanvl("partial_quality", F.lit(None).cast("double")))
    judged = (F.col("diag_status") == "ok") & F.col("q").isNotNull()
    late = F.coalesce(F.nanvl("spill_seconds", F.lit(0.0)), F.lit(0.0))
    out = cut.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n_interrupted"),
        F.count_if("has_output").alias("n_output"),
        F.count_if(judged).alias("n_judged"),
        F.sum(F.when(judged, F.col("q"))).alias("q_sum"),
        F.sum(F.when(judged & (F.col("q") >= threshold), F.col("q"))).alias("tp"),
        F.count_if(judged & (F.col("q") < threshold)).alias("n_low"),
        F.count_if(late > 0).alias("n_spill"),
        F.sum(late).alias("late_sum"),
    )
    r = lambda a, b, name: F.round(safe_ratio(a, b), 6).alias(name)
    return out.select(
        "model_name", "n_interrupted", "n_output", "n_judged", "n_low", "n_spill",
        r(F.col("n_interrupted") - F.col("n_output"), "n_interrupted", "no_output_rate"),
        r("q_sum", "n_judged", "mean_quality"),
        r("q_sum", "n_output", "quality_per_output"),
        r("n_spill", "n_interrupted", "spill_rate"),
        r("n_spill", "n_output", "spill_rate_output"),
        r("late_sum", "n_spill", "mean_late_seconds"),
        F.round(f1(F.coalesce("tp", F.lit(0.0)), F.col("n_low") + F.col("n_spill"), F.col("n_low")), 6).alias("f1"),
    )


def interruption_labels(rows: DataFrame, slots: DataFrame, bounds: DataFrame, near: float = 0.5, short_seconds: float = 2.0, short_chars: int = 20) -> DataFrame:
    """How each interrupted slot ended: the first label of the chain that fits.

    ``slots`` has the end of each slot (sample_id, slot_id, slot_end), ``bounds`` when a model began and ended
    to speak in it (model_name, sample_id, slot_id, response_start, response_end); without such a row only the
    end is known, from max_chunk_end. Words past the end overflow; output is short by its letters or by its
    seconds, and stopped near the interruption if it ended ``near`` seconds before the slot's end or later.
    """
    cut = rows.filter("is_interrupted").withColumn("has_output", has_output(rows)).join(slots.select("sample_id", "slot_id", "slot_end"), ["sample_id", "slot_id"], "left").join(bounds, ["model_name", "sample_id", "slot_id"], "left")
    late = F.coalesce(F.nanvl("spill_seconds", F.lit(0.0)), F.lit(0.0))
    chars = F.length(F.regexp_replace(F.coalesce("actual_text", F.lit("")), r"(?U)^\s+|\s+$", ""))
    end = F.coalesce("response_end", "max_chunk_end")
    seconds = F.greatest(F.lit(0.0), end - F.col("response_start"))
    is_short = F.coalesce(F.col("has_output") & ((chars <= short_chars) | F.coalesce(seconds <= short_seconds, F.lit(False))), F.lit(False))
    is_near = F.coalesce(F.col("has_output") & (F.coalesce("slot_end", F.lit(0.0)) - end <= near), F.lit(False))
    label = (
        F.when(late > 0, "overflow")
        .when(~F.col("has_output"), "no_output")
        .when(is_near & is_short, "short_near_interrupt")
        .when(is_near, "stopped_near_interrupt")
        .when(is_short, "short_finished_before_interrupt")
        .otherwise("finished_before_interrupt")
    )
    return cut.select("model_name", "sample_id", "slot_id", label.alias("label"))


def spill_statistics(rows: DataFrame) -> DataFrame:
    """Mean, median, 90th percentile (exact, interpolated) and maximum of positive spill; NULL if none."""
    v = F.nanvl("spill_seconds", F.lit(None).cast("double"))
    late = F.when(v > 0, v)
    r = lambda c, name: F.round(c, 6).alias(name)
    return rows.groupBy("model_name").agg(F.count(late).alias("n"), r(F.avg(late), "mean"), r(F.percentile(late, 0.5), "median"), r(F.percentile(late, 0.9), "p90"), r(F.max(late), "max"))


def spill_breakdown(rows: DataFrame) -> DataFrame:
    """Interrupted slots with and without spill: counts, rates and sums side by side."""
    late = F.coalesce(F.nanvl("spill_seconds", F.lit(0.0)), F.lit(0.0))
    over = late > 0
    fine = F.coalesce(F.nanvl("partial_quality", F.lit(None).cast("double")) >= 0.5, F.lit(False))
    n = lambda c, name: F.count_if(c).alias(name)
    out = rows.filter("is_interrupted").groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n"), n(over, "n_over"), n(~over, "n_within"), n(over & fine, "n_over_fine"), n(~over & fine, "n_within_fine"), n(over & (F.col("fp_delta") > 0), "n_over_fp"), n(~over & (F.col("fp_delta") > 0), "n_within_fp"), F.sum(F.when(over, F.col("fn_delta")).otherwise(0)).cast("bigint").alias("fn_over"), F.round(F.sum(late), 6).alias("late_seconds"),
    )
    return out.withColumn("over_rate", F.round(safe_ratio("n_over", "n"), 6)).withColumn("over_fine_rate", F.round(safe_ratio("n_over_fine", "n_over"), 6)).withColumn("within_fine_rate", F.round(safe_ratio("n_within_fine", "n_within"), 6))


def core_start_time(*precedence: str) -> Column:
    """The first known of the times at which an answer is taken to begin."""
    return F.coalesce(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in precedence])


def nested_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of outer and inner question per model and sample, from rows with scene_type, nested_role,
    question_type, step_index, slot_start, slot_id, score_core and core_start.

    A pair is a step, or two slot numbers that follow each other; of several outer or inner questions the first
    in time counts. A pair is completed if both were answered and the inner one no later than the outer one;
    a time that is not known is no reason against it. Aggregates only: no pair of rows is formed.
    """
    role = nested_role(F.col("scene_type"), F.col("nested_role"), F.col("question_type"), F.col("slot_id"))
    pair = F.coalesce(F.concat(F.lit("step_"), F.col("step_index").cast("string")), F.concat(F.lit("slot_pair_"), F.floor((F.col("slot_id") + 1) / 2).cast("string")), F.format_string("time_pair_%.3f", F.coalesce("slot_start", F.lit(0.0))))
    kept = rows.withColumn("role", role).filter(F.col("role").isin("outer", "inner")).withColumn("pair", pair)
    order = F.struct(F.coalesce("slot_start", F.lit(0.0)), F.coalesce("slot_id", F.lit(1_000_000_000)))
    value = F.struct(F.greatest(F.lit(0.0), F.coalesce(F.nanvl("score_core", F.lit(0.0)), F.lit(0.0))).alias("score"), F.col("core_start").alias("at"))
    first = lambda r: F.min_by(F.when(F.col("role") == r, value), F.when(F.col("role") == r, order))
    pairs = kept.groupBy("model_name", "sample_id", "pair").agg(first("outer").alias("o"), first("inner").alias("i"))
    whole = F.col("o").isNotNull() & F.col("i").isNotNull()
    q1, q2 = F.col("o.score"), F.col("i.score")
    both = whole & (q1 > 0) & (q2 > 0)
    in_order = F.coalesce(F.col("i.at") <= F.col("o.at"), F.lit(True))
    return pairs.select(
        "model_name", "sample_id", "pair",
        (~whole).alias("is_missing"),
        (whole & (q1 <= 0)).alias("outer_missed"),
        (whole & (q2 <= 0)).alias("inner_missed"),
        (both & ~in_order).alias("order_error"),
        F.when(both & in_order, F.sqrt(q1 * q2)).otherwise(F.lit(0.0)).alias("score"),
    )


def nested_completion(pairs: DataFrame) -> DataFrame:
    """Per model the mean over ``nested_pairs``, and why pairs were not completed."""
    n = lambda c: F.count_if(F.col(c)).alias(f"n_{c}")
    return pairs.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_pairs"), n("is_missing"), n("outer_missed"), n("inner_missed"), n("order_error"), F.count_if(F.col("score") > 0).alias("n_success"), F.round(safe_ratio(F.sum("score"), F.count(F.lit(1))), 6).alias("completion"))


def is_math(*paths: Column) -> Column:
    """Whether one of a sample's paths lies in the folder of the mathematical samples."""
    return F.exists(F.array(*[F.coalesce(p, F.lit("")) for p in paths]), lambda p: p.contains("/1q1a_math/") | p.contains("\\1q1a_math\\"))


def by_subtraction(rows: DataFrame, clamped: bool) -> DataFrame:
    """Real-time without inner, proactive without outer questions, by subtracting sums; ``clamped`` keeps
    counts from falling below 0."""
    part = lambda when, sign: [F.sum(F.when(when, c).otherwise(0)) * sign for c in (F.col("tp_n"), F.col("fp_delta"), F.col("fn"), F.lit(1))]
    minus = lambda a, b: [x - y for x, y in zip(part(a, 1), part(b, 1), strict=True)]
    real, pro = minus(F.col("question_type") == "realtime", F.col("role") == "inner"), minus(F.col("question_type") == "proactive", F.col("role") == "outer")
    nested = part(F.col("role") != "none", 1)
    low = (lambda c: F.greatest(c, F.lit(0))) if clamped else (lambda c: c)
    item = lambda name, v: F.struct(F.lit(name).alias("class"), v[0].alias("tp"), low(v[1]).cast("bigint").alias("fp"), low(v[2]).cast("bigint").alias("fn"), low(v[3]).cast("bigint").alias("n_slots"))
    out = rows.groupBy("model_name").agg(F.array(item("realtime", real), item("proactive", pro), item("nested", nested)).alias("x"))
    return finalized(out.select("model_name", F.explode("x").alias("x")).select("model_name", "x.*"), ["model_name", "class"])


def exclusive_f1(classes: DataFrame) -> DataFrame:
    """Micro, macro and support-weighted F1 over classes."""
    support = F.col("n_slots")
    return classes.groupBy("model_name").agg(
        F.round(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")), 5).alias("micro_f1"),
        F.round(F.avg("f1"), 5).alias("macro_f1"),
        F.round(safe_ratio(F.sum(F.col("f1") * support), F.sum(support)), 5).alias("weighted_f1"),
    )


def best_model(totals: DataFrame, metric: str, order: list[str]) -> DataFrame:
    """The model with the largest metric; of equals the first in the fixed order, then by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("model_name")), F.lit(0)), F.lit(len(order) + 1))
    return totals.agg(F.max_by("model_name", F.struct(metric, -rank)).alias("model_name"), F.max(metric).alias(metric))


def least_spill(rows: DataFrame) -> DataFrame:
    """The model with the least mean spill; one without output counts as infinitely bad."""
    per = spill_statistics(rows)
    cost = F.when(F.col("n") == 0, F.lit(float("inf"))).otherwise(F.col("mean"))
    return per.agg(F.min_by("model_name", F.struct(cost.alias("cost"), "model_name")).alias("model_name"), F.round(F.min(cost), 6).alias("mean_spill"))


def flattened(totals: DataFrame, breakdown: DataFrame) -> DataFrame:
    """One wide row per model from two summaries."""
    return totals.select("model_name", "n_slots", "precision", "recall", F.col("f1").alias("f1_all")).join(breakdown.select("model_name", F.col("n").alias("interrupted_n"), F.col("over_rate").alias("interrupted_over_rate")), "model_name", "left")


def cross_summary(rows: DataFrame) -> DataFrame:
    """Two summaries of one row each side by side: a cross join of aggregates."""
    a = rows.filter("NOT is_interrupted").agg(F.count(F.lit(1)).alias("n_free"), F.round(safe_ratio(F.sum("score_core"), F.count(F.lit(1))), 6).alias("core_free"))
    b = rows.filter("is_interrupted").agg(F.count(F.lit(1)).alias("n_cut"), F.round(safe_ratio(F.sum("score_core"), F.count(F.lit(1))), 6).alias("core_cut"))
    return a.crossJoin(b).withColumn("core_delta", F.round(F.col("core_cut") - F.col("core_free"), 6))


def ranked_models(totals: DataFrame, order: list[str]) -> DataFrame:
    """Models in a fixed order, the rest by name."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("model_name"))
    place = F.row_number().over(Window.partitionBy().orderBy(F.when(at == 0, 99).otherwise(at), "model_name"))  # a row per model
    return totals.select("model_name", "f1", place.alias("place"))


def judged(rows: DataFrame, verdicts: DataFrame, keys: list[str], neutral: float = 0.0) -> DataFrame:
    """A judge whose verdicts are a table: joined where there, ``neutral`` and marked where not."""
    return rows.join(verdicts, keys, "left").withColumn("is_cached", F.col("verdict").isNotNull()).withColumn("verdict", F.coalesce("verdict", F.lit(neutral)))
