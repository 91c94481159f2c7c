"""Metrics over the evaluated slots: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import metrics as M
from cadenza.operators import timeline as T
from cadenza.plans import Query
from cadenza.plans import timeline as TL
from cadenza.sources.tables import once

#: Models in the order in which reports list them; others follow by name.
ORDER = ["quill_duplex", "merle_stream", "ostrea_omni_8b", "larkvoice_rt"]


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return M.evaluated(spark, folder)


def _totals(spark: SparkSession, folder: str) -> DataFrame:
    return M.finalized(_rows(spark, folder).groupBy("model_name").agg(*M.soft_sums()), ["model_name"])


def f1_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _totals(spark, folder)


def f1_with_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return M.global_with_unmatched(_rows(spark, folder), TL.unmatched_chunks(spark, folder))


def f1_groupings(spark: SparkSession, folder: str) -> DataFrame:
    return M.by_groupings(_rows(spark, folder))


def f1_two_level(spark: SparkSession, folder: str) -> DataFrame:
    return M.two_level(_rows(spark, folder))


def pure_scores(spark: SparkSession, folder: str) -> DataFrame:
    return M.pure_scores(_rows(spark, folder))


def interruptions(spark: SparkSession, folder: str) -> DataFrame:
    return M.interruptions(_rows(spark, folder))


def interruption_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every interrupted slot with how it ended."""
    slots = T.clean_slots(spark, folder)
    spoken = TL._phased(spark, folder).filter("slot_id IS NOT NULL")
    bounds = spoken.groupBy("model_name", "sample_id", "slot_id").agg(F.min("chunk_start").alias("response_start"), F.max("chunk_end").alias("response_end"))
    return M.interruption_labels(_rows(spark, folder), slots, bounds)


def spill_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return M.spill_statistics(_rows(spark, folder))


def spill_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return M.spill_breakdown(_rows(spark, folder))


def _nested_pairs(spark: SparkSession, folder: str) -> DataFrame:
    slots = once(spark, folder, "slots", ["sample_id", "slot_id", "start", "end", "t_a", "nested_role", "step_index"]).select("sample_id", "slot_id", F.least("start", "end").alias("slot_start"), "t_a", "nested_role", "step_index")
    core = TL._phased(spark, folder).filter("phase = 'core'").groupBy("model_name", "sample_id", "slot_id").agg(F.min("chunk_start").alias("first_core"))
    rows = _rows(spark, folder).filter("scene_type = 'nested'").join(slots, ["sample_id", "slot_id"], "left").join(core, ["model_name", "sample_id", "slot_id"], "left")
    effective = F.greatest("first_core", "t_a")
    return M.nested_pairs(rows.withColumn("effective", F.when(F.col("first_core").isNotNull(), effective)).withColumn("core_start", M.core_start_time("effective", "first_core", "max_chunk_end")))


def nested_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _nested_pairs(spark, folder).withColumn("score", F.round("score", 6))


def f1_math_subset(spark: SparkSession, folder: str) -> DataFrame:
    """The totals of the mathematical samples and of the rest, told apart by the paths of a sample."""
    m = once(spark, folder, "sample_manifest", ["subset", "video", "annotation"])
    path = lambda c: F.concat_ws("/", F.lit("data"), F.col("subset"), F.col(c))
    marked = _rows(spark, folder).join(m.select("sample_id", M.is_math(path("video"), path("annotation")).alias("is_math")), "sample_id", "left")
    return M.finalized(marked.withColumn("is_math", F.coalesce("is_math", F.lit(False))).groupBy("model_name", "is_math").agg(*M.soft_sums()), ["model_name", "is_math"])


def f1_by_scene_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """Groups in the order of their key, as reports list them."""
    return M.finalized(_rows(spark, folder).groupBy("scene_type").agg(*M.soft_sums()), ["scene_type"]).orderBy("scene_type")


def nested_completion(spark: SparkSession, folder: str) -> DataFrame:
    return M.nested_completion(_nested_pairs(spark, folder))


def paper_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return M.by_subtraction(_rows(spark, folder), clamped=True)


def exclusive_classes(spark: SparkSession, folder: str) -> DataFrame:
    return M.by_subtraction(_rows(spark, folder), clamped=False)


def exclusive_f1(spark: SparkSession, folder: str) -> DataFrame:
    return M.exclusive_f1(exclusive_classes(spark, folder))


def best_model(spark: SparkSession, folder: str) -> DataFrame:
    return M.best_model(_totals(spark, folder), "f1", ORDER)


def least_spill(spark: SparkSession, folder: str) -> DataFrame:
    return M.least_spill(_rows(spark, folder))


def flat_summary(spark: SparkSession, folder: str) -> DataFrame:
    return M.flattened(_totals(spark, folder), spill_breakdown(spark, folder))


def cross_summary(spark: SparkSession, folder: str) -> DataFrame:
    return M.cross_summary(_rows(spark, folder))


def ranked_models(spark: SparkSession, folder: str) -> DataFrame:
    return M.ranked_models(_totals(spark, folder), ORDER)


def judge_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts kept from earlier runs joined to interrupted slots; those without one are to be judged."""
    rows = _rows(spark, folder).filter("is_interrupted")
    known = rows.filter("diag_status = 'ok' AND partial_quality IS NOT NULL").select("model_name", "sample_id", "slot_id", F.col("partial_quality").alias("verdict"))
    out = M.judged(rows.select("model_name", "sample_id", "slot_id"), known, ["model_name", "sample_id", "slot_id"])
    return out.groupBy("model_name", "is_cached").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("verdict"), 6).alias("verdict_sum"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (f1_totals, f1_with_unmatched, f1_groupings, f1_two_level, pure_scores, interruptions, interruption_labels, spill_statistics, spill_breakdown, nested_pairs, nested_completion, f1_math_subset, f1_by_scene_sorted, paper_metrics, exclusive_classes, exclusive_f1, best_model, least_spill, flat_summary, cross_summary, ranked_models, judge_cache)
}
_T = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))"
_U = f"""WITH u AS (SELECT * REPLACE ({_T.format("scene_type")} AS scene_type, coalesce(nullif({_T.format("question_type")}, ''), 'unknown') AS question_type,
    CASE WHEN isnan(spill_seconds) THEN NULL ELSE spill_seconds END AS spill_seconds, CASE WHEN isnan(partial_quality) THEN NULL ELSE partial_quality END AS partial_quality),
    CASE WHEN is_interrupted THEN 0 ELSE CAST(coalesce(score_core, 0) <= 0 AS INTEGER) END AS fn,
    CASE WHEN {_T.format("scene_type")} = 'nested' THEN CASE WHEN {_T.format("question_type")} = 'proactive' THEN 'outer' WHEN {_T.format("question_type")} = 'realtime' THEN 'inner' WHEN slot_id % 2 = 1 THEN 'outer' ELSE 'inner' END ELSE 'none' END AS role,
    (coalesce(num_chunks, 0) > 0 OR length(regexp_replace(coalesce(actual_text, ''), '[\\s\\x{{a0}}\\x{{3000}}]', '', 'g')) > 0) AS has_output
  FROM (SELECT DISTINCT ON (eval_id) * FROM unified_eval))
"""
_SUMS = "sum(tp_n) AS tp, CAST(sum(fp_delta) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) AS n_slots"


def _r(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END)"


def _f(tp: str, fp: str, fn: str) -> str:
    p, r = _r(tp, f"{tp} + {fp}"), _r(tp, f"{tp} + {fn}")
    return _r(f"2 * {p} * {r}", f"{p} + {r}")


def _final(keys: str) -> str:
    return f"{keys}, n_slots, round(tp, 6) AS tp, fp, fn, round({_r('tp', 'tp + fp')}, 6) AS precision, round({_r('tp', 'tp + fn')}, 6) AS recall, round({_f('tp', 'fp', 'fn')}, 6) AS f1"


_TOT = _U + f", t0 AS (SELECT model_name, {_SUMS} FROM u GROUP BY model_name), t AS (SELECT {_final('model_name')} FROM t0)"
_LATE = "coalesce(spill_seconds, 0)"
_SPILL = "count(*) FILTER (spill_seconds > 0) AS n, round(avg(spill_seconds) FILTER (spill_seconds > 0), 6) AS mean, round(quantile_cont(spill_seconds, 0.5) FILTER (spill_seconds > 0), 6) AS median, round(quantile_cont(spill_seconds, 0.9) FILTER (spill_seconds > 0), 6) AS p90, round(max(spill_seconds) FILTER (spill_seconds > 0), 6) AS max"
_FINE = "coalesce(partial_quality >= 0.5, false)"
_BREAK = f"""SELECT *, round({_r('n_over', 'n')}, 6) AS over_rate, round({_r('n_over_fine', 'n_over')}, 6) AS over_fine_rate, round({_r('n_within_fine', 'n_within')}, 6) AS within_fine_rate FROM (
  SELECT model_name, count(*) AS n, count(*) FILTER ({_LATE} > 0) AS n_over, count(*) FILTER (NOT {_LATE} > 0) AS n_within, count(*) FILTER ({_LATE} > 0 AND {_FINE}) AS n_over_fine, count(*) FILTER (NOT {_LATE} > 0 AND {_FINE}) AS n_within_fine,
    count(*) FILTER ({_LATE} > 0 AND fp_delta > 0) AS n_over_fp, count(*) FILTER (NOT {_LATE} > 0 AND fp_delta > 0) AS n_within_fp, CAST(sum(CASE WHEN {_LATE} > 0 THEN fn_delta ELSE 0 END) AS BIGINT) AS fn_over, round(sum({_LATE}), 6) AS late_seconds
  FROM u WHERE is_interrupted GROUP BY model_name)"""
_JUDGED = "(diag_status = 'ok' AND partial_quality IS NOT NULL)"


def _subtracted(clamped: bool) -> str:
    low = (lambda c: f"greatest({c}, 0)") if clamped else (lambda c: c)
    s = lambda c, when: f"sum(CASE WHEN {when} THEN {c} ELSE 0 END)"
    parts = []
    for name, a, b in (("realtime", "question_type = 'realtime'", "role = 'inner'"), ("proactive", "question_type = 'proactive'", "role = 'outer'"), ("nested", "role <> 'none'", "false")):
        d = lambda c, a=a, b=b: f"{s(c, a)} - {s(c, b)}"
        parts.append(f"SELECT model_name, '{name}' AS class, {d('tp_n')} AS tp, CAST({low(d('fp_delta'))} AS BIGINT) AS fp, CAST({low(d('fn'))} AS BIGINT) AS fn, CAST({low(d('1'))} AS BIGINT) AS n_slots FROM u GROUP BY model_name")
    return f", k AS ({' UNION ALL '.join(parts)}), kk AS (SELECT {_final('model_name, class')} FROM k)"


_NESTED = TL._MATCH + ", " + _U.replace("WITH ", "", 1) + f""", so AS (SELECT DISTINCT ON (slot_uid) sample_id, slot_id, least(start, "end") AS st, t_a, {_T.format("nested_role")} AS nr, step_index FROM slots),
fc AS (SELECT model_name, sample_id, slot_id, min(cs) AS fc FROM p WHERE phase = 'core' GROUP BY ALL),
nr AS (SELECT u.model_name, u.sample_id, u.slot_id, so.st, CASE WHEN nr IN ('outer', 'inner') THEN nr ELSE role END AS role, coalesce('step_' || step_index, 'slot_pair_' || ((u.slot_id + 1) // 2)) AS pair, greatest(0, coalesce(score_core, 0)) AS sc, CASE WHEN fc IS NOT NULL THEN greatest(fc, coalesce(so.t_a, fc)) ELSE u.max_chunk_end END AS began
  FROM u LEFT JOIN so ON so.sample_id = u.sample_id AND so.slot_id = u.slot_id LEFT JOIN fc ON fc.model_name = u.model_name AND fc.sample_id = u.sample_id AND fc.slot_id = u.slot_id WHERE u.scene_type = 'nested'),
ng AS (SELECT model_name, sample_id, pair, arg_min({{'s': sc, 'a': began}}, (coalesce(st, 0), slot_id)) FILTER (role = 'outer') AS o, arg_min({{'s': sc, 'a': began}}, (coalesce(st, 0), slot_id)) FILTER (role = 'inner') AS i FROM nr GROUP BY ALL),
nx AS (SELECT *, o IS NULL OR i IS NULL AS is_missing, coalesce(o.s > 0 AND i.s > 0, false) AS ok, coalesce(i.a <= o.a, true) AS io FROM ng),
np AS (SELECT model_name, sample_id, pair, is_missing, NOT is_missing AND coalesce(o.s <= 0, false) AS outer_missed, NOT is_missing AND coalesce(i.s <= 0, false) AS inner_missed, ok AND NOT io AS order_error, CASE WHEN ok AND io THEN sqrt(o.s * i.s) ELSE 0.0 END AS score FROM nx)
"""
_PLACE = "CASE model_name " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(ORDER)) + " ELSE 99 END"
ORACLES = {
    "f1_totals": _TOT + " SELECT * FROM t",
    "f1_with_unmatched": TL._MATCH + ", " + _TOT.replace("WITH ", "", 1) + f", x AS (SELECT model_name, count(*) AS n_unmatched FROM p WHERE slot_id IS NULL GROUP BY ALL), y AS (SELECT t0.model_name, coalesce(n_unmatched, 0) AS n_unmatched, tp, fp + coalesce(n_unmatched, 0) AS fp, fn, n_slots FROM t0 LEFT JOIN x ON t0.model_name = x.model_name) SELECT {_final('model_name, n_unmatched')} FROM y",
    "f1_groupings": _U + f""", g AS (SELECT model_name, scene_type, question_type, role, is_interrupted, {_SUMS}, grouping(scene_type) AS a, grouping(question_type) AS b, grouping(role) AS c, grouping(is_interrupted) AS d
  FROM u GROUP BY GROUPING SETS ((model_name), (model_name, scene_type), (model_name, question_type), (model_name, role), (model_name, is_interrupted))),
h AS (SELECT *, CASE WHEN a = 0 THEN 'scene_type' WHEN b = 0 THEN 'question_type' WHEN c = 0 THEN 'role' WHEN d = 0 THEN 'is_interrupted' ELSE 'all' END AS grouping, coalesce(scene_type, question_type, role, CAST(is_interrupted AS VARCHAR), '') AS value FROM g)
SELECT {_final('model_name, grouping, value')} FROM h""",
    "f1_two_level": _U + f", t0 AS (SELECT model_name, count(DISTINCT sample_id) AS n_samples, {_SUMS}, sum(score_core) AS cs, count(score_core) AS cn FROM u GROUP BY model_name) SELECT {_final('model_name, n_samples')}, round({_r('cs', 'cn')}, 6) AS mean_core FROM t0",
    "pure_scores": _U + f" SELECT model_name, scene_type, round({_r('sum(coalesce(score_core, 0))', 'count(*)')}, 6) AS core_all, " + ", ".join(f"round({_r(f'sum(CASE WHEN NOT is_interrupted THEN coalesce({c}, 0) END)', 'count(*) FILTER (NOT is_interrupted)')}, 6) AS {n}" for c, n in (("score_core", "core_free"), ("score_ack", "ack_free"), ("tp_n", "tp_free"))) + " FROM u GROUP BY ALL",
    "interruptions": _U + f""", g AS (SELECT model_name, count(*) AS n_interrupted, count(*) FILTER (has_output) AS n_output, count(*) FILTER {_JUDGED} AS n_judged, sum(partial_quality) FILTER {_JUDGED} AS qs, coalesce(sum(partial_quality) FILTER ({_JUDGED} AND partial_quality >= 0.5), 0) AS tp, count(*) FILTER ({_JUDGED} AND partial_quality < 0.5) AS n_low, count(*) FILTER ({_LATE} > 0) AS n_spill, sum({_LATE}) AS ls FROM u WHERE is_interrupted GROUP BY model_name)
SELECT model_name, n_interrupted, n_output, n_judged, n_low, n_spill, round({_r('n_interrupted - n_output', 'n_interrupted')}, 6) AS no_output_rate, round({_r('qs', 'n_judged')}, 6) AS mean_quality, round({_r('qs', 'n_output')}, 6) AS quality_per_output, round({_r('n_spill', 'n_interrupted')}, 6) AS spill_rate, round({_r('n_spill', 'n_output')}, 6) AS spill_rate_output, round({_r('ls', 'n_spill')}, 6) AS mean_late_seconds, round({_f('tp', '(n_low + n_spill)', 'n_low')}, 6) AS f1 FROM g""",
    "interruption_labels": TL._MATCH + ", " + _U.replace("WITH ", "", 1) + rf""", b AS (SELECT model_name, sample_id, slot_id, min(cs) AS rs, max(ce) AS re FROM p WHERE slot_id IS NOT NULL GROUP BY ALL),
l AS (SELECT u.model_name, u.sample_id, u.slot_id, {_LATE} AS late, has_output, length(regexp_replace(coalesce(actual_text, ''), '^[\s\x{{a0}}\x{{3000}}]+|[\s\x{{a0}}\x{{3000}}]+$', '', 'g')) AS n, coalesce(s.e0, 0) AS se, coalesce(b.re, u.max_chunk_end) AS re, rs
  FROM u LEFT JOIN s ON s.sample_id = u.sample_id AND s.slot_id = u.slot_id LEFT JOIN b ON b.model_name = u.model_name AND b.sample_id = u.sample_id AND b.slot_id = u.slot_id WHERE u.is_interrupted),
f AS (SELECT *, coalesce(has_output AND (n <= 20 OR coalesce(greatest(0, re - rs) <= 2, false)), false) AS short, coalesce(has_output AND se - re <= 0.5, false) AS near FROM l)
SELECT model_name, sample_id, slot_id, CASE WHEN late > 0 THEN 'overflow' WHEN NOT has_output THEN 'no_output' WHEN near AND short THEN 'short_near_interrupt' WHEN near THEN 'stopped_near_interrupt' WHEN short THEN 'short_finished_before_interrupt' ELSE 'finished_before_interrupt' END AS label FROM f""",
    "spill_statistics": _U + f" SELECT model_name, {_SPILL} FROM u GROUP BY model_name",
    "spill_breakdown": _U + _BREAK,
    "nested_pairs": _NESTED + " SELECT model_name, sample_id, pair, is_missing, outer_missed, inner_missed, order_error, round(score, 6) AS score FROM np",
    "nested_completion": _NESTED + f" SELECT model_name, count(*) AS n_pairs, count(*) FILTER (is_missing) AS n_is_missing, count(*) FILTER (outer_missed) AS n_outer_missed, count(*) FILTER (inner_missed) AS n_inner_missed, count(*) FILTER (order_error) AS n_order_error, count(*) FILTER (score > 0) AS n_success, round({_r('sum(score)', 'count(*)')}, 6) AS completion FROM np GROUP BY model_name",
    "f1_math_subset": _U + rf""", m AS (SELECT DISTINCT ON (sample_id) sample_id, contains('data/' || subset || '/' || video, '/1q1a_math/') OR contains('data/' || subset || '/' || annotation, '/1q1a_math/') AS is_math FROM sample_manifest),
t0 AS (SELECT model_name, coalesce(is_math, false) AS is_math, {_SUMS} FROM u LEFT JOIN m USING (sample_id) GROUP BY ALL) SELECT {_final('model_name, is_math')} FROM t0""",
    "f1_by_scene_sorted": _U + f", t0 AS (SELECT scene_type, {_SUMS} FROM u GROUP BY ALL) SELECT {_final('scene_type')} FROM t0 ORDER BY scene_type",
    "paper_metrics": _U + _subtracted(True) + " SELECT * FROM kk",
    "exclusive_classes": _U + _subtracted(False) + " SELECT * FROM kk",
    "exclusive_f1": _U + _subtracted(False) + f" SELECT model_name, round({_f('sum(tp)', 'sum(fp)', 'sum(fn)')}, 5) AS micro_f1, round(avg(f1), 5) AS macro_f1, round({_r('sum(f1 * n_slots)', 'sum(n_slots)')}, 5) AS weighted_f1 FROM kk GROUP BY model_name",
    "best_model": _TOT + f" SELECT model_name, f1 FROM t ORDER BY f1 DESC, {_PLACE} LIMIT 1",
    "least_spill": _U + f", x AS (SELECT model_name, {_SPILL} FROM u GROUP BY model_name) SELECT model_name, round(mean, 6) AS mean_spill FROM x WHERE n > 0 ORDER BY mean, model_name LIMIT 1",
    "flat_summary": _TOT + f", b AS ({_BREAK}) SELECT t.model_name, n_slots, precision, recall, f1 AS f1_all, b.n AS interrupted_n, over_rate AS interrupted_over_rate FROM t LEFT JOIN b ON t.model_name = b.model_name",
    "cross_summary": _U + f", z AS (SELECT count(*) FILTER (NOT is_interrupted) AS n_free, round({_r('sum(score_core) FILTER (NOT is_interrupted)', 'count(*) FILTER (NOT is_interrupted)')}, 6) AS core_free, count(*) FILTER (is_interrupted) AS n_cut, round({_r('sum(score_core) FILTER (is_interrupted)', 'count(*) FILTER (is_interrupted)')}, 6) AS core_cut FROM u) SELECT *, round(core_cut - core_free, 6) AS core_delta FROM z",
    "ranked_models": _TOT + f" SELECT model_name, f1, CAST(row_number() OVER (ORDER BY {_PLACE}, model_name) AS INTEGER) AS place FROM t",
    "judge_cache": _U + f", j AS (SELECT model_name, {_JUDGED} IS TRUE AS is_cached, CASE WHEN {_JUDGED} THEN partial_quality ELSE 0 END AS v FROM u WHERE is_interrupted) SELECT model_name, is_cached, count(*) AS n, round(sum(v), 6) AS verdict_sum FROM j GROUP BY ALL",
}
