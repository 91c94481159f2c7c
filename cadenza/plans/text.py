"""Text and scalar functions over the tables: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.functions import text as X
from cadenza.plans import Query
from cadenza.sources.tables import once, table

#: Times as annotations write them, most of them well, by row of a table.
_TIMES = ["90", "1:02", "1:00:05", " 3.5 ", "", "a:b", "1:2:3:4", "0:07"]


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")


def parse_time(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, _TIMES)), (F.col("p_partkey") % len(_TIMES) + 1).cast("int"))
    return _numbered(spark, folder).select("p_partkey", S.parse_time(raw).alias("seconds"), raw.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$").alias("is_clock"))


def to_bool(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ["Yes", "t", "0", " TRUE ", "no", "1"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return _numbered(spark, folder).select("p_partkey", S.to_bool(raw).alias("flag"))


def bounded(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("p_retailprice") / 1000 - 1
    return _numbered(spark, folder).select("p_partkey", F.round(S.clamp(x), 6).alias("clamped"), F.round(S.safe_ratio(x, F.col("p_size") - 10), 6).alias("ratio"), F.round(S.decay(F.col("p_size").cast("double"), F.lit(10.0), F.lit(40.0), 1.0, 2.0), 6).alias("decayed"))


def normalized_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.length(X.normalized("text")).alias("n_letters"))


def language_test(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy(F.when(S.contains_cjk("text"), "zh").otherwise("en").alias("detected")).agg(F.count(F.lit(1)).alias("n"))


def common_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    s = once(spark, folder, "slots", ["question_text", "gt_answer"])
    return s.filter("question_text IS NOT NULL AND gt_answer IS NOT NULL").select("slot_uid", X.common_prefix("question_text", "gt_answer").cast("int").alias("n"))


def numerals(spark: SparkSession, folder: str) -> DataFrame:
    """Chinese numerals in annotated questions and answers, by value."""
    s = once(spark, folder, "slots", ["gt_answer"]).select(F.explode(F.regexp_extract_all("gt_answer", F.lit("([零一二两三四五六七八九十百]+)"), 1)).alias("numeral"))
    return s.groupBy("numeral").agg(F.count(F.lit(1)).alias("n")).withColumn("value", X.chinese_numeral("numeral"))


def numeral_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of numeral tokens among the words of a chunk, merged."""
    words = once(spark, folder, "chunks", ["aligned_words"]).filter("aligned_words IS NOT NULL").select("model_name", "sample_id", "chunk_id", F.posexplode("aligned_words").alias("i", "w"))
    words = words.withColumn("is_numeral", F.coalesce(F.col("w.text").rlike("^[0-9零一二两三四五六七八九十百]+$"), F.lit(False)))
    chunk = Window.partitionBy("model_name", "sample_id", "chunk_id").orderBy("i")
    run = words.withColumn("run", F.sum(F.when(F.col("is_numeral"), 0).otherwise(1)).over(chunk)).filter("is_numeral")
    merged = run.groupBy("model_name", "sample_id", "chunk_id", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w.text"))), lambda x: x["text"]), "").alias("token"))
    return merged.select("model_name", "sample_id", "chunk_id", "token")


def covered_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """How much of a chunk's text its aligned words cover."""
    c = once(spark, folder, "chunks", ["text", "aligned_words"]).filter("aligned_words IS NOT NULL AND text IS NOT NULL")
    return c.select("model_name", "sample_id", "chunk_id", F.length(X.covered_prefix("text", F.transform("aligned_words", lambda w: w["text"]))).alias("n_covered"), F.length("text").alias("n_chars"))


def absolute_words(spark: SparkSession, folder: str) -> DataFrame:
    """Word times as an aligner gives them, from 0 at the first word of a chunk, laid on the chunk's own start, to
    three decimals; a chunk without start keeps its words out."""
    c = once(spark, folder, "chunks", ["start", "aligned_words"]).filter("aligned_words IS NOT NULL AND start IS NOT NULL")
    first = F.array_min(F.transform("aligned_words", lambda w: w["start"]))
    rel = c.select("model_name", "sample_id", "chunk_id", "start", F.posexplode(F.transform("aligned_words", lambda w: w["start"] - first)).alias("i", "rel"))
    return rel.filter("rel IS NOT NULL").select("model_name", "sample_id", "chunk_id", "i", F.floor((F.col("start") + F.col("rel")) * 1000 + 0.5).alias("absolute_ms"))


def judge_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and labels out of what a judge wrote."""
    i = F.col("p_partkey") % 5
    raw = F.when(i == 0, F.concat(F.lit('Verdict: {"score": 0.'), (F.col("p_size") % 10).cast("string"), F.lit(', "label": "x"} done'))).when(i == 1, "I give 0.7 because").when(i == 2, "clear Halluci-nation").when(i == 3, "Not Relevant, 3 of 10").otherwise("no idea")
    rows = _numbered(spark, folder).withColumn("raw", raw)
    return rows.select("p_partkey", F.round(X.judge_score("raw"), 6).alias("score"), X.json_object("raw").alias("object"))


def early_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Categories and scores out of what a judge of early parts wrote."""
    i, tenth = F.col("p_partkey") % 8, (F.col("p_size") % 20).cast("string")
    raw = (
        F.when(i == 0, F.concat(F.lit('So: {"flag": "Neutral", "score": 0.'), tenth, F.lit("}"))).when(i == 1, '{"flag": "HALLUCI NATION", "score": 1}').when(i == 2, "it is neutral").when(i == 3, F.concat(F.lit('{"flag": "neutral", "score": "'), tenth, F.lit('"}')))
        .when(i == 4, '{"score": 0.7}').when(i == 5, '{"flag": "neutral"}').when(i == 6, "Hallucination!").otherwise("")
    )
    v = _numbered(spark, folder).select("p_partkey", X.early_verdict(raw).alias("v"))
    return v.select("p_partkey", "v.category", F.round("v.score", 6).alias("score"))


def formatted(spark: SparkSession, folder: str) -> DataFrame:
    rows = _numbered(spark, folder)
    return rows.select("p_partkey", X.subtitle_time(F.col("p_partkey") * 7 + F.lit(0.25)).alias("shown"), X.html_escaped(F.concat(F.lit("<b>'"), "p_name", F.lit("' & \"x\"</b>"))).alias("escaped"), X.safe_name("p_name").alias("safe"), F.size(X.comma_list(F.concat(F.lit(" a, ,"), "p_name", F.lit(",b ")))).alias("n_list"), X.fixed(F.col("p_size") / F.lit(8.0), 3).alias("fixed"))


def pairs_and_waits(spark: SparkSession, folder: str) -> DataFrame:
    rows = _numbered(spark, folder).withColumn("pair", X.pair_of(F.concat(F.lit("m"), F.col("p_size").cast("string"), F.lit("=/a=b"))))
    a, b = X.seconds_of(F.col("p_size") * 100.0, F.col("p_size") * 400.0)
    return rows.select("p_partkey", F.col("pair.name").alias("name"), F.col("pair.path").alias("path"), X.retry_wait(F.col("p_partkey") % 8).alias("wait"), F.round(a, 6).alias("start_s"), F.round(b, 6).alias("end_s"), (F.col("p_size") * 64).alias("vision_tokens"), F.round(F.col("p_size") * 0.5, 3).alias("audio_seconds"), F.round(-23.0 - (-0.691 + 10 * F.log10(F.col("p_retailprice"))), 6).alias("gain"))


def steps_and_phrases(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.size(X.numbered_steps("text")).alias("n_steps"), X.find_phrase("text", F.lit('"The Camera"')).alias("at"), X.first_float("text").alias("first_number"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (parse_time, to_bool, bounded, normalized_text, language_test, common_prefixes, numerals, numeral_runs, covered_prefix, absolute_words, judge_parse, early_verdicts, formatted, pairs_and_waits, steps_and_phrases)
}
_RAW = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TIMES)) + " END"
_ESC = "'<b>''' || p_name || ''' & \"x\"</b>'"
ORACLES = {
    "parse_time": rf"""WITH x AS (SELECT p_partkey, {_RAW} AS raw FROM part), y AS (SELECT *, string_split(trim(raw), ':') AS s FROM x)
SELECT p_partkey, CASE len(s) WHEN 1 THEN TRY_CAST(s[1] AS DOUBLE) WHEN 2 THEN TRY_CAST(s[1] AS DOUBLE) * 60 + TRY_CAST(s[2] AS DOUBLE) WHEN 3 THEN TRY_CAST(s[1] AS DOUBLE) * 3600 + TRY_CAST(s[2] AS DOUBLE) * 60 + TRY_CAST(s[3] AS DOUBLE) END AS seconds, regexp_full_match(raw, '\d{{1,2}}:\d{{2}}(:\d{{2}})?') AS is_clock FROM y""",
    "to_bool": "SELECT p_partkey, lower(trim(CASE p_partkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 't' WHEN 2 THEN '0' WHEN 3 THEN ' TRUE ' WHEN 4 THEN 'no' ELSE '1' END)) IN ('1', 'true', 'yes', 'y', 't') AS flag FROM part",
    "bounded": "WITH x AS (SELECT p_partkey, p_size, p_retailprice / 1000 - 1 AS v FROM part) SELECT p_partkey, round(greatest(0, least(1, v)), 6) AS clamped, round(CASE WHEN p_size > 10 THEN v / (p_size - 10) ELSE 0 END, 6) AS ratio, round(CASE WHEN p_size <= 10 THEN 1 WHEN p_size >= 40 THEN 0 ELSE 1 - pow((p_size - 10) / 30.0::DOUBLE, 2) END, 6) AS decayed FROM part JOIN x USING (p_partkey, p_size)",
    "language_test": r"SELECT CASE WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN 'zh' ELSE 'en' END AS detected, count(*) AS n FROM documents GROUP BY ALL",
    "common_prefixes": "WITH s AS (SELECT DISTINCT slot_uid, question_text AS a, gt_answer AS b FROM slots WHERE question_text IS NOT NULL AND gt_answer IS NOT NULL) SELECT slot_uid, CAST(coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))), 0) AS INTEGER) AS n FROM s",
    "numeral_runs": r"""WITH c AS (SELECT DISTINCT ON (model_name, sample_id, chunk_id) * FROM chunks WHERE aligned_words IS NOT NULL), w AS (SELECT model_name, sample_id, chunk_id, unnest(range(1, len(aligned_words) + 1)) AS i, unnest(aligned_words).text AS tx FROM c),
f AS (SELECT *, coalesce(regexp_full_match(tx, '[0-9零一二两三四五六七八九十百]+'), false) AS num FROM w), r AS (SELECT *, sum(CASE WHEN num THEN 0 ELSE 1 END) OVER (PARTITION BY model_name, sample_id, chunk_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT model_name, sample_id, chunk_id, string_agg(tx, '' ORDER BY i) AS token FROM r WHERE num GROUP BY model_name, sample_id, chunk_id, run""",
    "absolute_words": "WITH c AS (SELECT DISTINCT ON (model_name, sample_id, chunk_id) * FROM chunks WHERE aligned_words IS NOT NULL AND start IS NOT NULL), w AS (SELECT model_name, sample_id, chunk_id, start, list_min(list_transform(aligned_words, lambda x: x.start)) AS f, unnest(range(len(aligned_words))) AS i, unnest(aligned_words).start AS ws FROM c) SELECT model_name, sample_id, chunk_id, CAST(i AS INTEGER) AS i, CAST(floor((start + (ws - f)) * 1000 + 0.5) AS BIGINT) AS absolute_ms FROM w WHERE ws IS NOT NULL",
    "numerals": r"""WITH s AS (SELECT DISTINCT ON (slot_uid) * FROM slots), n AS (SELECT unnest(regexp_extract_all(gt_answer, '([零一二两三四五六七八九十百]+)', 1)) AS numeral FROM s), g AS (SELECT numeral, count(*) AS n FROM n GROUP BY ALL),
t AS (SELECT *, translate(numeral, '零一二两三四五六七八九十百', '01223456789tb') AS d FROM g)
SELECT numeral, n, CASE WHEN regexp_full_match(d, '[0-9]+') THEN CAST(d AS BIGINT) ELSE CAST(coalesce(list_sum(list_transform(regexp_extract_all(d, '([0-9]?)b', 1), lambda x: 100 * coalesce(nullif(TRY_CAST(x AS INTEGER), 0), 1))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(d, '([0-9]?)t', 1), lambda x: 10 * coalesce(nullif(TRY_CAST(x AS INTEGER), 0), 1))), 0) + coalesce(TRY_CAST(regexp_extract(d, '([0-9])$', 1) AS INTEGER), 0) AS BIGINT) END AS value FROM t""",
    "early_verdicts": """WITH x AS (SELECT p_partkey, p_partkey % 8 AS i, p_size % 20 AS t FROM part)
SELECT p_partkey, CASE WHEN i IN (1, 6) THEN 'hallucination' ELSE 'neutral' END AS category, CAST(CASE i WHEN 0 THEN CAST('0.' || t AS DOUBLE) WHEN 2 THEN 1 WHEN 3 THEN least(1, t) WHEN 5 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM x""",
    "judge_parse": """WITH x AS (SELECT p_partkey, p_partkey % 5 AS i, p_size % 10 AS d FROM part)
SELECT p_partkey, CAST(CASE i WHEN 0 THEN d / 10.0 WHEN 1 THEN 0.7 WHEN 3 THEN 1 ELSE 0 END AS DOUBLE) AS score, CASE WHEN i = 0 THEN '{"label":"x","score":0.' || d || '}' END AS object FROM x""",
    "formatted": f"""WITH x AS (SELECT *, CAST(floor((p_partkey * 7 + 0.25) * 100 + 0.5) AS BIGINT) AS c FROM part)
SELECT p_partkey, (c // 360000) || ':' || lpad(CAST(c // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(c // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS shown,
  replace(replace(replace(replace(replace({_ESC}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, regexp_replace(p_name, '[^a-zA-Z0-9_-]', '_', 'g') AS safe, 3 AS n_list, printf('%.3f', p_size / 8.0::DOUBLE) AS fixed FROM x""",
    "pairs_and_waits": "SELECT p_partkey, 'm' || p_size AS name, '/a=b' AS path, least(pow(2.0, p_partkey % 8), 30.0) AS wait, round(CASE WHEN p_size * 400.0 > 10000 THEN p_size * 100.0::DOUBLE / 1000 ELSE p_size * 100.0::DOUBLE END, 6) AS start_s, round(CASE WHEN p_size * 400.0 > 10000 THEN p_size * 400.0::DOUBLE / 1000 ELSE p_size * 400.0::DOUBLE END, 6) AS end_s, p_size * 64 AS vision_tokens, round(p_size * 0.5::DOUBLE, 3) AS audio_seconds, round(-23.0 - (-0.691 + 10 * log10(p_retailprice)), 6) AS gain FROM part",
    "steps_and_phrases": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^\s*\d+[.)]\s*(.+)$', 1)) AS INTEGER) AS n_steps, CAST(CASE WHEN instr(text, 'The Camera') > 0 THEN instr(text, 'The Camera') ELSE instr(lower(text), 'the camera') END AS INTEGER) AS at, TRY_CAST(nullif(regexp_extract(text, '[-+]?\d+(?:\.\d+)?', 0), '') AS DOUBLE) AS first_number FROM documents WHERE text IS NOT NULL",
}
