"""p4: runs of the same chunk in the output of a model for a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.runs import collapse_runs
from cadenza.sources.tables import table

KEYS = ["model_name", "sample_id"]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = collapse_runs(table(spark, folder, "chunks"), KEYS, "chunk_id", "text")
    return runs.select(*KEYS, F.col("first_id").alias("first_chunk_id"), F.col("last_id").alias("last_chunk_id"))


def p4_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The same runs with their number of chunks, their times and duration."""
    both = F.col("start").isNotNull() & F.col("end").isNotNull()
    low, high = F.when(both, F.least("start", "end")), F.when(both, F.greatest("start", "end"))
    runs = collapse_runs(table(spark, folder, "chunks"), KEYS, "chunk_id", "text", low, high)
    return runs.withColumnsRenamed({"first_id": "first_chunk_id", "last_id": "last_chunk_id", "n_events": "n_chunks"})


#: Full-width forms and their plain ones, by rule; other compatibility forms do not occur in the texts.
_WIDE, _PLAIN = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_SQL = rf"""WITH c AS (SELECT DISTINCT model_name, sample_id, chunk_id, text, start, "end" FROM chunks),
x AS (SELECT *, regexp_replace(lower(translate(text, '{_WIDE}', '{_PLAIN}')), '[^\p{{L}}\p{{N}}]', '', 'g') AS r FROM c WHERE text IS NOT NULL),
y AS (SELECT *, lag(r) OVER (PARTITION BY model_name, sample_id ORDER BY chunk_id) AS b FROM x WHERE r <> ''),
w AS (SELECT *, length(r) >= 10 AND length(b) >= 10 AND abs(length(r) - length(b)) <= 1 AND r <> b AND regexp_replace(r, '[^\p{{N}}]', '', 'g') = regexp_replace(b, '[^\p{{N}}]', '', 'g') AS near FROM y),
v AS (SELECT *, CASE WHEN near THEN coalesce(list_max(list_filter(range(1, least(length(r), length(b)) + 1), lambda i: left(r, i) = left(b, i))), 0) END AS head, CASE WHEN near THEN coalesce(list_max(list_filter(range(1, least(length(r), length(b)) + 1), lambda i: right(r, i) = right(b, i))), 0) END AS tail FROM w),
z AS (SELECT *, coalesce(r = b OR (near AND (head + tail >= greatest(length(r), length(b)) - 1 OR (length(r) = length(b) AND head + tail = length(r) - 2 AND substr(r, head + 1, 1) = substr(b, head + 2, 1) AND substr(r, head + 2, 1) = substr(b, head + 1, 1)))), false) AS same FROM v),
g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY model_name, sample_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS run FROM z),
t AS (SELECT *, CASE WHEN start IS NOT NULL AND "end" IS NOT NULL THEN least(start, "end") END AS lo, CASE WHEN start IS NOT NULL AND "end" IS NOT NULL THEN greatest(start, "end") END AS hi FROM g),
o AS (SELECT model_name, sample_id, min(chunk_id) AS first_chunk_id, max(chunk_id) AS last_chunk_id, count(*) AS n_chunks, min(lo) AS start, max(hi) AS "end" FROM t GROUP BY model_name, sample_id, run HAVING count(*) >= 2)
"""
QUERIES = {"p4_found": p4_found, "p4_runs": p4_runs}
ORACLES = {
    "p4_found": _SQL + " SELECT model_name, sample_id, first_chunk_id, last_chunk_id FROM o",
    "p4_runs": _SQL + ' SELECT model_name, sample_id, first_chunk_id, last_chunk_id, CAST(n_chunks AS BIGINT) AS n_chunks, start, "end", "end" - start AS duration FROM o',
}
