"""p8: personal information in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.pii import redact_documents
from cadenza.sources.tables import table


def _redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redact_documents(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    items = _redacted(spark, folder).select("doc_id", F.explode("items").alias("i"))
    return items.select("doc_id", "i.pii_type", "i.char_start")


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its text redacted and the number of items replaced."""
    return _redacted(spark, folder).select("doc_id", "text", F.size("items").alias("n_items"))


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted}
ORACLES: dict[str, str] = {}
