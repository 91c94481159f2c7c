"""What is moved between tasks stays near the input, also where the result is far larger."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as entry


def _written(spark) -> int:
    """Bytes of shuffle files that the session's stages have written so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, getattr(spark._jvm.scala.Array, "emptyDoubleArray")(), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_later_answers_of_a_long_sample_move_little(spark, tmp_path):
    """A sample of 16,000 slots has 8 GB of later lines; no more than 20 times its text may be moved for them."""
    n, draw = 16_000, random.Random(1)
    answers = [f"{draw.getrandbits(200):050x}" for _ in range(n)]
    rows = [{"slot_uid": i, "sample_id": "a", "slot_id": i, "start": float(i), "t_a": i + 0.25, "end": i + 0.5, "scene_type": "multi_turn", "gt_answer": a, "updated_at": 0} for i, a in enumerate(answers)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "slots.parquet")
    sizes = [len(f"- slot {i}: {a}") + 1 for i, a in enumerate(answers)]
    before = _written(spark)
    made = entry.queries()["later_answers"](spark, str(tmp_path)).agg(F.count(F.lit(1)), F.sum(F.octet_length("later"))).first()
    moved = _written(spark) - before
    assert tuple(made) == (n, sum(i * s for i, s in enumerate(sizes)) - (n - 1) + len("(none)"))
    assert moved < 20 * sum(sizes), moved / sum(sizes)
