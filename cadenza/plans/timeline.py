"""Slots and chunks: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.scalars import clean_label
from cadenza.operators import timeline as T
from cadenza.plans import Query
from cadenza.sources.tables import once

_SLOTS = """
s AS (SELECT slot_uid, sample_id, slot_id, least(start, "end") AS s0, t_a, greatest(start, "end") AS e0, scene_type, is_interrupted, boundary_type, gt_answer, step_index
  FROM (SELECT DISTINCT ON (slot_uid) * FROM slots) WHERE start IS NOT NULL AND "end" IS NOT NULL AND t_a IS NOT NULL)"""
_CHUNKS = """
c AS (SELECT model_name, sample_id, chunk_id, least(start, "end") AS cs, greatest(start, "end") AS ce, text, aligned_words
  FROM (SELECT DISTINCT ON (model_name, sample_id, chunk_id) * FROM chunks) WHERE start IS NOT NULL AND "end" IS NOT NULL)"""
_MATCH = f"""WITH {_SLOTS}, {_CHUNKS},
m AS (SELECT c.*, s.slot_id, s.s0, s.t_a, s.e0,
    row_number() OVER (PARTITION BY c.model_name, c.sample_id, c.chunk_id ORDER BY s.s0 DESC NULLS LAST, s.slot_id DESC NULLS LAST) AS rn
  FROM c LEFT JOIN s ON c.sample_id = s.sample_id AND c.cs >= s.s0 AND c.cs < s.e0),
p AS (SELECT *, CASE WHEN slot_id IS NULL THEN NULL WHEN cs < t_a THEN 'early' ELSE 'core' END AS phase,
    coalesce(cs < t_a AND t_a < ce, false) AS is_cross, coalesce(ce > e0, false) AS is_spill FROM m WHERE rn = 1)
"""


def _phased(spark: SparkSession, folder: str, chunk_columns: tuple[str, ...] = ()) -> DataFrame:
    return T.with_phase(T.match_chunks(T.clean_chunks(spark, folder, chunk_columns), T.clean_slots(spark, folder)))


def chunk_slot_match(spark: SparkSession, folder: str) -> DataFrame:
    return _phased(spark, folder).select("model_name", "sample_id", "chunk_id", "slot_id", "phase", "is_cross", "is_spill")


def unmatched_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _phased(spark, folder).filter("slot_id IS NULL").select("model_name", "sample_id", "chunk_id")


def phase_counts(spark: SparkSession, folder: str) -> DataFrame:
    return T.phase_counts(_phased(spark, folder))


def slot_texts(spark: SparkSession, folder: str) -> DataFrame:
    return T.slot_texts(_phased(spark, folder, ("text",)))


def boundary_split(spark: SparkSession, folder: str) -> DataFrame:
    return T.split_at_answer(_phased(spark, folder, ("text", "aligned_words")))


def _questions(spark: SparkSession, folder: str, scene: str) -> DataFrame:
    rows = T.clean_slots(spark, folder, ("scene_type",)).filter(clean_label("scene_type") == scene)
    return rows.select("sample_id", "slot_uid", F.col("slot_start").alias("q"), F.col("t_a").alias("a"))


def slots_multi_turn(spark: SparkSession, folder: str) -> DataFrame:
    return T.multi_turn_slots(_questions(spark, folder, "multi_turn"))


def slots_stepwise(spark: SparkSession, folder: str) -> DataFrame:
    return T.stepwise_slots(_questions(spark, folder, "1qna"))


def slots_nested(spark: SparkSession, folder: str) -> DataFrame:
    return T.nested_slots(_questions(spark, folder, "nested"))


def slots_by_scene(spark: SparkSession, folder: str) -> DataFrame:
    """All three builders behind one dispatch on the scene; an unknown scene is an error."""
    rows = T.clean_slots(spark, folder, ("scene_type",)).withColumn("scene", clean_label("scene_type"))
    known = rows.filter(F.when(F.col("scene").isin("multi_turn", "1qna", "nested"), True).otherwise(F.raise_error(F.concat(F.lit("unknown scene "), F.coalesce("scene", F.lit("NULL"))))).cast("boolean"))
    part = lambda scene: known.filter(F.col("scene") == scene).select("sample_id", "slot_uid", F.col("slot_start").alias("q"), F.col("t_a").alias("a"))
    built = [(s, f(part(s))) for s, f in (("multi_turn", T.multi_turn_slots), ("1qna", T.stepwise_slots))]
    out = [df.select(F.lit(s).alias("scene"), "sample_id", "slot_start", "t_a", "slot_end") for s, df in built]
    nested = T.nested_slots(part("nested")).select(F.lit("nested").alias("scene"), "sample_id", "slot_start", "t_a", "slot_end")
    return out[0].unionByName(out[1]).unionByName(nested)


def containment_pairs(spark: SparkSession, folder: str) -> DataFrame:
    slots = T.clean_slots(spark, folder)
    return T.containment_pairs(slots.select("sample_id", F.col("slot_id").alias("id"), F.col("slot_start").alias("low"), F.col("slot_end").alias("high")))


def word_chunk_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Words against the chunks of the same model and sample, 0.15 s of tolerance, counted per chunk."""
    chunks = T.clean_chunks(spark, folder, ("aligned_words",)).withColumn("k", F.concat_ws("|", "model_name", "sample_id"))
    words = chunks.select("k", "chunk_id", F.posexplode("aligned_words").alias("i", "w")).filter("w.start IS NOT NULL AND w.end IS NOT NULL")
    words = words.select("k", F.struct("chunk_id", "i").alias("l_id"), F.least("w.start", "w.end").alias("l_low"), F.greatest("w.start", "w.end").alias("l_high"))
    whole = chunks.select("k", F.col("chunk_id").alias("r_id"), F.col("chunk_start").alias("r_low"), F.col("chunk_end").alias("r_high"))
    pairs = T.overlap_join(words, whole, "k", 0.15)
    return pairs.groupBy("k", F.col("r_id").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n_words"))


def asof_slot(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk with the last slot of its sample that started at or before it."""
    chunks = T.clean_chunks(spark, folder).select("sample_id", F.struct("model_name", "chunk_id").alias("event_id"), F.col("chunk_start").alias("t"))
    slots = T.clean_slots(spark, folder).select("sample_id", F.col("slot_start").alias("t"), "slot_id")
    return T.asof_backward(chunks, slots, "sample_id", "slot_id").select("sample_id", "event_id.model_name", "event_id.chunk_id", "slot_id")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Scores by verdicts that are made up from the number of the first chunk of a stage: a table stands for the
    judge. One chunk in 97 has no verdict."""
    phased = _phased(spark, folder)
    slots = T.clean_slots(spark, folder, ("is_interrupted", "boundary_type", "scene_type", "step_index")).withColumn("scene_type", clean_label("scene_type")).withColumn("is_hard", T.effective_boundary(F.col("is_interrupted"), F.col("boundary_type")) == "Hard")
    # The models that took part in a sample: a row per run that is listed, not a product of tables.
    runs = once(spark, folder, "batch_result", ["model_name", "sample_id"]).select("model_name", "sample_id").distinct()
    first = lambda phase: F.min_by(F.when(F.col("phase") == phase, F.col("chunk_id")), F.when(F.col("phase") == phase, F.struct("chunk_start", "chunk_end", "chunk_id")))
    heard = phased.filter("slot_id IS NOT NULL").groupBy("model_name", "sample_id", "slot_id").agg(first("early").alias("e"), first("core").alias("c"), F.min(F.when((F.col("phase") == "core") & (F.col("chunk_id") % 3 == 0), F.col("chunk_start"))).alias("anchor"))
    verdicts = heard.select(
        "model_name", "sample_id", "slot_id", "anchor",
        F.when(F.col("e") % 97 != 0, F.when(F.col("e") % 7 == 0, "hallucination").otherwise("neutral")).alias("category"),
        ((F.col("e") % 10) / 10).alias("s_ack"),
        F.when(F.col("c") % 97 != 0, (F.col("c") % 100) / 100).alias("s_core"),
    )
    return T.stage_scores(phased, slots.join(runs, "sample_id"), verdicts)


def stage_scores(spark: SparkSession, folder: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _scored(spark, folder).select("model_name", "sample_id", "slot_id", r("score_ack"), r("score_core"), r("tp"), "fp", "fn", "has_verdict")


def scored_until_failure(spark: SparkSession, folder: str) -> DataFrame:
    """The slots of a run up to its first without a verdict."""
    return T.until_failure(_scored(spark, folder), unmatched_chunks(spark, folder))


def full_context(spark: SparkSession, folder: str) -> DataFrame:
    """The context of the core part of every slot: parts of chunks that run over t_a bring their whole chunk."""
    phased = _phased(spark, folder, ("text", "aligned_words"))
    uncut = phased.filter("phase = 'core'").select("model_name", "sample_id", "slot_id", "chunk_id", "text", F.col("chunk_start").alias("part_start"), F.col("chunk_end").alias("part_end"))
    cut = T.split_at_answer(phased).filter("part = 'core'").join(phased.filter("is_cross").select("model_name", "sample_id", "chunk_id", "slot_id"), ["model_name", "sample_id", "chunk_id"])
    stage = uncut.unionByName(cut.select(*uncut.columns))
    return T.full_context(stage, phased)


def later_answers(spark: SparkSession, folder: str) -> DataFrame:
    slots = T.clean_slots(spark, folder, ("scene_type", "gt_answer")).withColumn("scene_type", clean_label("scene_type"))
    return T.later_answers(slots)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (chunk_slot_match, unmatched_chunks, phase_counts, slot_texts, boundary_split, slots_multi_turn, slots_stepwise, slots_nested, slots_by_scene, containment_pairs, word_chunk_overlap, asof_slot, stage_scores, scored_until_failure, full_context, later_answers)
}
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_Q = f"""WITH {_SLOTS}, q AS (SELECT sample_id, slot_uid, s0 AS q, t_a AS a FROM s WHERE lower({_TRIM.format("scene_type")}) = '{{}}')
"""
#: The greedy search for pairs, a state per question in order of time.
_GREEDY = """n AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY q, a, slot_uid) AS i FROM q),
st AS (SELECT sample_id, i, q AS oq, a AS oa, 0 AS pair, NULL::DOUBLE AS po, NULL::DOUBLE AS pa, NULL::DOUBLE AS iq, NULL::DOUBLE AS ia FROM n WHERE i = 1
  UNION ALL SELECT n.sample_id, n.i, CASE WHEN h THEN NULL WHEN st.oq IS NULL THEN n.q ELSE st.oq END, CASE WHEN h THEN NULL WHEN st.oq IS NULL THEN n.a ELSE st.oa END, st.pair + CAST(h AS INTEGER), CASE WHEN h THEN st.oq END, CASE WHEN h THEN st.oa END, CASE WHEN h THEN n.q END, CASE WHEN h THEN n.a END
  FROM st JOIN n ON n.sample_id = st.sample_id AND n.i = st.i + 1, LATERAL (SELECT coalesce(st.oq < n.q AND n.q < st.oa AND n.a <= st.oa, false) AS h)),
pr AS (SELECT *, greatest(coalesce(lead(po) OVER (PARTITION BY sample_id ORDER BY pair), pa + 60), pa) AS oe FROM st WHERE iq IS NOT NULL),
ns AS (SELECT sample_id, pair, 'outer' AS role, po AS slot_start, pa AS t_a, oe AS slot_end FROM pr UNION ALL SELECT sample_id, pair, 'inner', iq, ia, pa FROM pr)"""
_SCORED = f"""{_MATCH},
g AS (SELECT model_name, sample_id, slot_id, min(CASE WHEN phase = 'early' THEN cs END) AS fe, min(CASE WHEN phase = 'core' THEN cs END) AS fc, max(ce) AS le, min(CASE WHEN phase = 'core' AND chunk_id % 3 = 0 THEN cs END) AS anchor,
    arg_min(chunk_id, (cs, ce, chunk_id)) FILTER (phase = 'early') AS ei, arg_min(chunk_id, (cs, ce, chunk_id)) FILTER (phase = 'core') AS ci
  FROM p WHERE slot_id IS NOT NULL GROUP BY ALL),
r AS (SELECT DISTINCT model_name, sample_id FROM batch_result),
j AS (SELECT r.model_name, s.sample_id, s.slot_id, s.s0, s.t_a, s.e0, s.is_interrupted, (s.is_interrupted OR coalesce(lower({_TRIM.format("s.boundary_type")}), '') <> 'soft') AS hard, fe, CASE WHEN NOT s.is_interrupted THEN fc END AS fc, anchor, le,
    CASE WHEN ei % 97 <> 0 THEN CASE WHEN ei % 7 = 0 THEN 'hallucination' ELSE 'neutral' END END AS cat, (ei % 10) / 10.0::DOUBLE AS sa, CASE WHEN ci % 97 <> 0 THEN (ci % 100) / 100.0::DOUBLE END AS sc,
    CASE WHEN lower({_TRIM.format("s.scene_type")}) = '1qna' AND coalesce(s.step_index, s.slot_id, 1) > 1 THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END AS w
  FROM s JOIN r USING (sample_id) LEFT JOIN g ON g.model_name = r.model_name AND g.sample_id = s.sample_id AND g.slot_id = s.slot_id),
i AS (SELECT *, CASE WHEN fc IS NOT NULL THEN greatest(coalesce(CASE WHEN sc > 0 THEN anchor END, fc), t_a) END AS ft FROM j),
k AS (SELECT *,
    CASE WHEN fe IS NULL OR cat IS NULL OR cat <> 'neutral' THEN 0 ELSE sa * w * CASE WHEN fe <= s0 THEN 1 WHEN t_a <= s0 OR fe >= t_a THEN 0 ELSE greatest(0, least(1, 1 - (fe - s0) / (t_a - s0))) END END AS score_ack,
    CASE WHEN fc IS NULL OR sc IS NULL OR sc < 0.5 THEN 0 ELSE sc * (1 - w) * CASE WHEN ft <= t_a THEN 1 WHEN e0 <= t_a OR ft >= e0 THEN 0 ELSE greatest(0, least(1, 1 - (ft - t_a) / (e0 - t_a))) END END AS score_core FROM i),
z AS (SELECT model_name, sample_id, slot_id, s0, CAST(score_ack AS DOUBLE) AS score_ack, CAST(score_core AS DOUBLE) AS score_core, greatest(0, least(1, CAST(score_ack + score_core AS DOUBLE))) AS tp,
    CAST(coalesce(fe IS NOT NULL AND cat = 'hallucination', false) AS INTEGER) + CAST(coalesce(fc IS NOT NULL AND sc < 0.5, false) AS INTEGER) + CAST(coalesce(le > e0 AND hard, false) AS INTEGER) AS fp,
    CASE WHEN is_interrupted THEN 0 ELSE CAST(score_core <= 0 AS INTEGER) END AS fn, NOT (fe IS NOT NULL AND cat IS NULL OR fc IS NOT NULL AND sc IS NULL) AS has_verdict FROM k)
"""
ORACLES = {
    "chunk_slot_match": _MATCH + "SELECT model_name, sample_id, chunk_id, slot_id, phase, is_cross, is_spill FROM p",
    "unmatched_chunks": _MATCH + "SELECT model_name, sample_id, chunk_id FROM p WHERE slot_id IS NULL",
    "phase_counts": _MATCH + """SELECT model_name, sample_id, slot_id, count(*) AS num_chunks, count(*) FILTER (phase = 'early') AS num_early, count(*) FILTER (phase = 'core') AS num_core,
  count(*) FILTER (is_spill) AS num_spill, count(*) FILTER (is_cross) AS num_cross FROM p WHERE slot_id IS NOT NULL GROUP BY ALL""",
    "slot_texts": _MATCH + r"""SELECT model_name, sample_id, slot_id,
  regexp_replace(coalesce(string_agg(text, '' ORDER BY cs, ce, chunk_id) FILTER (phase = 'early'), ''), '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g') AS text_early,
  regexp_replace(coalesce(string_agg(text, '' ORDER BY cs, ce, chunk_id) FILTER (phase = 'core'), ''), '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g') AS text_core FROM p WHERE slot_id IS NOT NULL GROUP BY ALL""",
    "slots_multi_turn": _Q.format("multi_turn") + """SELECT sample_id, slot_uid, CAST(row_number() OVER w AS INTEGER) AS ordinal, q AS slot_start, a AS t_a, greatest(coalesce(lead(q) OVER w, a + 60), q) AS slot_end FROM q WINDOW w AS (PARTITION BY sample_id ORDER BY q, a, slot_uid)""",
    "slots_stepwise": _Q.format("1qna") + """, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY a, slot_uid) AS INTEGER) AS step, min(q) OVER (PARTITION BY sample_id) AS q0, lead(a) OVER (PARTITION BY sample_id ORDER BY a, slot_uid) AS na FROM q)
SELECT sample_id, slot_uid, step, CASE WHEN step = 1 THEN q0 ELSE a END AS slot_start, a AS t_a, greatest(coalesce(na, a + 60), CASE WHEN step = 1 THEN q0 ELSE a END) AS slot_end FROM n""",
    "containment_pairs": f"WITH {_SLOTS} SELECT o.sample_id, o.slot_id AS outer_id, arg_min(i.slot_id, (i.s0, i.slot_id)) AS inner_id FROM s o JOIN s i ON o.sample_id = i.sample_id AND i.s0 > o.s0 AND i.s0 < o.e0 AND i.e0 <= o.e0 GROUP BY ALL",
    "word_chunk_overlap": f"""WITH {_CHUNKS}, w AS (SELECT model_name, sample_id, unnest(aligned_words) AS w FROM c),
x AS (SELECT model_name, sample_id, least(w.start, w."end") AS a, greatest(w.start, w."end") AS b FROM w WHERE w.start IS NOT NULL AND w."end" IS NOT NULL)
SELECT c.model_name || '|' || c.sample_id AS k, c.chunk_id, count(*) AS n_words FROM c JOIN x ON c.model_name = x.model_name AND c.sample_id = x.sample_id AND x.b >= c.cs - 0.15 AND x.a <= c.ce + 0.15 GROUP BY ALL""",
    "asof_slot": f"""WITH {_SLOTS}, {_CHUNKS}, u AS (SELECT sample_id, s0, max(slot_id) AS slot_id FROM s GROUP BY ALL)
SELECT c.sample_id, c.model_name, c.chunk_id, u.slot_id FROM c ASOF LEFT JOIN u ON c.sample_id = u.sample_id AND c.cs >= u.s0""",
    "stage_scores": _SCORED + "SELECT model_name, sample_id, slot_id, round(score_ack, 6) AS score_ack, round(score_core, 6) AS score_core, round(tp, 6) AS tp, fp, fn, has_verdict FROM z",
    "scored_until_failure": _SCORED + """, f AS (SELECT model_name, sample_id, min((s0, slot_id)) AS fa FROM z WHERE NOT has_verdict GROUP BY ALL), l AS (SELECT model_name, sample_id, count(*) AS n FROM p WHERE slot_id IS NULL GROUP BY ALL),
q AS (SELECT z.*, fa, fa IS NULL OR (s0, slot_id) < fa AS ct FROM z LEFT JOIN f USING (model_name, sample_id)), t AS (SELECT model_name, sample_id, any_value(fa) AS fa, count(*) FILTER (ct) AS n_slots, round(coalesce(sum(tp) FILTER (ct), 0), 6) AS tp, coalesce(sum(fp) FILTER (ct), 0) AS fp, coalesce(sum(fn) FILTER (ct), 0) AS fn FROM q GROUP BY ALL)
SELECT model_name, sample_id, CASE WHEN fa IS NULL THEN 'ok' ELSE 'failed' END AS status, fa[2] AS failed_slot_id, n_slots, tp, CAST(fp + CASE WHEN fa IS NULL THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM t LEFT JOIN l USING (model_name, sample_id)""",
    "full_context": _MATCH + r""", y AS (SELECT *, phase = 'core' OR (is_cross AND len(list_filter(coalesce(aligned_words, []), lambda w: w.start IS NOT NULL AND w."end" IS NOT NULL AND w.start >= t_a)) > 0) AS in_core, regexp_replace(coalesce(text, ''), '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g') AS tx FROM p WHERE slot_id IS NOT NULL),
x AS (SELECT *, len(list_filter(coalesce(aligned_words, []), lambda w: w.start IS NOT NULL AND w."end" IS NOT NULL AND w.start >= t_a AND coalesce(w.text, '') <> '')) AS nw FROM y WHERE in_core)
SELECT model_name, sample_id, slot_id, string_agg(tx, '' ORDER BY cs, ce, chunk_id) AS context FROM x GROUP BY ALL""",
    "slots_nested": _Q.format("nested").replace("WITH", "WITH RECURSIVE", 1) + f", {_GREEDY} SELECT sample_id, CAST(pair AS INTEGER) AS pair, role, slot_start, t_a, slot_end FROM ns",
    "slots_by_scene": f"""WITH RECURSIVE {_SLOTS}, qm AS (SELECT sample_id, slot_uid, s0 AS q, t_a AS a FROM s WHERE lower({_TRIM.format("scene_type")}) = 'multi_turn'), q1 AS (SELECT sample_id, slot_uid, s0 AS q, t_a AS a FROM s WHERE lower({_TRIM.format("scene_type")}) = '1qna'), q AS (SELECT sample_id, slot_uid, s0 AS q, t_a AS a FROM s WHERE lower({_TRIM.format("scene_type")}) = 'nested'),
{_GREEDY}, o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY a, slot_uid) AS step, min(q) OVER (PARTITION BY sample_id) AS q0, lead(a) OVER (PARTITION BY sample_id ORDER BY a, slot_uid) AS na FROM q1)
SELECT 'multi_turn' AS scene, sample_id, q AS slot_start, a AS t_a, greatest(coalesce(lead(q) OVER (PARTITION BY sample_id ORDER BY q, a, slot_uid), a + 60), q) AS slot_end FROM qm
UNION ALL SELECT '1qna', sample_id, CASE WHEN step = 1 THEN q0 ELSE a END, a, greatest(coalesce(na, a + 60), CASE WHEN step = 1 THEN q0 ELSE a END) FROM o
UNION ALL SELECT 'nested', sample_id, slot_start, t_a, slot_end FROM ns""",
    "boundary_split": _MATCH + r""", w AS (SELECT *, list_sort(list_filter(coalesce(aligned_words, []), lambda w: w.start IS NOT NULL AND w."end" IS NOT NULL)) AS ws FROM p WHERE is_cross),
sd AS (SELECT *, unnest(['early', 'core']) AS side FROM w), pt AS (SELECT *, list_filter(list_sort(list_transform(ws, lambda w: {'a': w.start, 'b': w."end", 't': w.text})), lambda w: CASE WHEN side = 'early' THEN w.a < t_a ELSE w.a >= t_a END) AS us FROM sd),
tk AS (SELECT *, list_filter(list_transform(us, lambda u: u.t), lambda t: t <> '') AS ts FROM pt)
SELECT model_name, sample_id, chunk_id, phase AS part, coalesce(text, '') AS text, cs AS part_start, ce AS part_end FROM w WHERE len(ws) = 0
UNION ALL SELECT model_name, sample_id, chunk_id, side, CASE WHEN regexp_matches(coalesce(list_aggregate(ts, 'string_agg', ''), ''), '[\x{4e00}-\x{9fff}]') THEN list_aggregate(ts, 'string_agg', '') ELSE coalesce(list_aggregate(ts, 'string_agg', ' '), '') END, list_min(list_transform(us, lambda u: u.a)), list_max(list_transform(us, lambda u: u.b)) FROM tk WHERE len(us) > 0""",
    "later_answers": f"""WITH {_SLOTS} SELECT sample_id, slot_id, coalesce(string_agg('- slot ' || slot_id || ': ' || coalesce(gt_answer, ''), chr(10)) OVER (PARTITION BY sample_id, lower({_TRIM.format("scene_type")}) ORDER BY s0, slot_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '(none)') AS later FROM s""",
}
