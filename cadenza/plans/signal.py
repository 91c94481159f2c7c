"""Sample vectors: queries over ``embeddings`` (64 samples each) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import signal as G
from cadenza.plans import Query
from cadenza.sources.tables import table


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _total(a: F.Column) -> F.Column:
    return F.aggregate(a, F.lit(0.0), lambda t, v: t + v)


def resample(spark: SparkSession, folder: str) -> DataFrame:
    y = _vectors(spark, folder).withColumn("y", G.resampled("x", 24))
    return y.select("vec_id", F.round(_total(F.col("y")), 5).alias("total"), F.round(F.get("y", F.lit(7)), 6).alias("eighth"))


def loudness_blocks(spark: SparkSession, folder: str) -> DataFrame:
    p = _vectors(spark, folder).withColumn("p", G.block_powers("x", 16, 4))
    return p.select("vec_id", F.size("p").alias("n_blocks"), F.round(G.integrated_loudness("p"), 5).alias("loudness"))


def pcm(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder).select("vec_id", F.aggregate(G.to_pcm16("x"), F.lit(0).cast("bigint"), lambda t, v: t + v).alias("pcm_sum"))


def voice_segments(spark: SparkSession, folder: str) -> DataFrame:
    p = F.transform("x", lambda v: F.lit(0.5) + v * 2)
    return _vectors(spark, folder).select("vec_id", F.explode(G.voice_activity(p)).alias("s")).select("vec_id", "s.start", "s.end")


def k_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Energy of the vectors after K-weighting, and the last sample that comes out."""
    y = _vectors(spark, folder).withColumn("y", G.k_weighted("x"))
    return y.select("vec_id", F.round(_total(F.transform("y", lambda v: v * v)), 5).alias("energy"), F.round(F.element_at("y", -1), 6).alias("last"))


def weighted_loudness(spark: SparkSession, folder: str) -> DataFrame:
    """Integrated loudness of the weighted samples, in blocks of 16 by 4."""
    p = _vectors(spark, folder).withColumn("y", G.k_weighted("x")).withColumn("p", G.block_powers("y", 16, 4))
    return p.select("vec_id", F.round(G.integrated_loudness("p"), 4).alias("loudness"))


def wav_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Samples written as WAV with silence up to a length, and read again: the largest error."""
    w = _vectors(spark, folder).withColumn("z", G.wav_samples(G.wav_bytes("x", 16000, 0.005)))
    err = F.array_max(F.zip_with("x", F.slice("z", 1, 64), lambda a, b: F.abs(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a)) - b)))
    return w.select("vec_id", F.size("z").alias("n_samples"), (err < 1e-4).alias("is_close"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (resample, loudness_blocks, pcm, voice_segments, k_weighted, weighted_loudness, wav_round_trip)}
_V = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda u: CAST(u AS DOUBLE)) AS x FROM embeddings)"
_S, _H = G.k_weighting(16000.0)
#: Both filters a sample at a time, their four delays carried along.
_KW = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda u: CAST(u AS DOUBLE)) AS x FROM embeddings), k AS (SELECT vec_id, x, 0 AS i, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q, 0.0::DOUBLE AS r, 0.0::DOUBLE AS s, 0.0::DOUBLE AS y FROM v
  UNION ALL SELECT vec_id, x, i + 1, {_S[1]!r} * u - {_S[3]!r} * a + q, {_S[2]!r} * u - {_S[4]!r} * a, {_H[1]!r} * a - {_H[3]!r} * b + s, {_H[2]!r} * a - {_H[4]!r} * b, b
  FROM (SELECT *, {_H[0]!r} * a + r AS b FROM (SELECT *, {_S[0]!r} * u + p AS a FROM (SELECT *, x[i + 1] AS u FROM k WHERE i < len(x)))))"""
ORACLES = {
    "resample": _V + """, i AS (SELECT vec_id, x, unnest(range(24)) AS i FROM v), y AS (SELECT vec_id, i, x[CAST(floor(i * 63 / 23.0::DOUBLE) AS INTEGER) + 1] * (1 - (i * 63 / 23.0::DOUBLE - floor(i * 63 / 23.0::DOUBLE))) + coalesce(x[CAST(floor(i * 63 / 23.0::DOUBLE) AS INTEGER) + 2], x[64]) * (i * 63 / 23.0::DOUBLE - floor(i * 63 / 23.0::DOUBLE)) AS y FROM i)
SELECT vec_id, round(sum(y), 5) AS total, round(max(CASE WHEN i = 7 THEN y END), 6) AS eighth FROM y GROUP BY vec_id""",
    "loudness_blocks": _V + """, b AS (SELECT vec_id, list_sum(list_transform(x[s:s + 15], lambda u: u * u)) / 16 AS p FROM (SELECT vec_id, x, unnest(range(1, 50, 4)) AS s FROM v)),
a AS (SELECT vec_id, count(*) AS n_blocks FROM b GROUP BY vec_id), l AS (SELECT * FROM b WHERE -0.691 + 10 * log10(p + 1e-30) > -70), g AS (SELECT vec_id, -0.691 + 10 * log10(avg(p) + 1e-30) - 10 AS gate FROM l GROUP BY vec_id),
r AS (SELECT vec_id, round(-0.691 + 10 * log10(avg(p) + 1e-30), 5) AS loudness FROM l JOIN g USING (vec_id) WHERE -0.691 + 10 * log10(p + 1e-30) > gate GROUP BY vec_id)
SELECT vec_id, CAST(n_blocks AS INTEGER) AS n_blocks, loudness FROM a LEFT JOIN r USING (vec_id)""",
    "k_weighted": _KW + " SELECT vec_id, round(sum(y * y), 5) AS energy, round(arg_max(y, i), 6) AS last FROM k WHERE i > 0 GROUP BY vec_id",
    "weighted_loudness": _KW + """, w AS (SELECT vec_id, list(y ORDER BY i) AS x FROM k WHERE i > 0 GROUP BY vec_id), b AS (SELECT vec_id, list_sum(list_transform(x[s:s + 15], lambda u: u * u)) / 16 AS p FROM (SELECT vec_id, x, unnest(range(1, 50, 4)) AS s FROM w)),
l AS (SELECT * FROM b WHERE -0.691 + 10 * log10(p + 1e-30) > -70), g AS (SELECT vec_id, -0.691 + 10 * log10(avg(p) + 1e-30) - 10 AS gate FROM l GROUP BY vec_id),
r AS (SELECT vec_id, round(-0.691 + 10 * log10(avg(p) + 1e-30), 4) AS loudness FROM l JOIN g USING (vec_id) WHERE -0.691 + 10 * log10(p + 1e-30) > gate GROUP BY vec_id)
SELECT vec_id, loudness FROM w LEFT JOIN r USING (vec_id)""",
    "pcm": _V + " SELECT vec_id, CAST(list_sum(list_transform(x, lambda u: CAST(floor(greatest(-1.0, least(1.0, u)) * 32767 + 0.5) AS BIGINT))) AS BIGINT) AS pcm_sum FROM v",
    "wav_round_trip": "SELECT vec_id, 80 AS n_samples, true AS is_close FROM embeddings",
}
