"""The benchmark tables: one Parquet file or folder per table, each row counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The key of each table some of whose rows were delivered twice, and its delivery time.
DELIVERED = {
    "sample_manifest": (("sample_id",), "listed_at"),
    "slots": (("slot_uid",), "updated_at"),
    "chunks": (("model_name", "sample_id", "chunk_id"), "recv_ts"),
    "unified_eval": (("eval_id",), "evaluated_at"),
    "batch_result": (("result_id",), "finished_at"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None, near: list[str] | None = None) -> DataFrame:
    """The table with each row once: its key, ``columns`` and the earliest delivery.

    Copies differ in the delivery time alone, so grouping by all other columns in use finds them. That
    is a plain hash aggregate with a map-side part; no group is ever gathered. With ``near`` rows are
    placed by these columns first, so that what joins on them next needs no second shuffle.
    """
    keys, delivered = DELIVERED[name]
    df = table(spark, folder, name)
    names = [c for c in (columns or df.columns) if c not in keys and c != delivered]
    df = df if near is None else df.select(*keys, *names, delivered).repartition(*near)
    return df.groupBy(*keys, *names).agg(F.min(delivered).alias(delivered))
