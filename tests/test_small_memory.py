"""Results larger than the memory are written row by row."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

WRITE = """
import sys
import __spark_entry__ as entry
from cadenza.session import build_session
spark = build_session("small", cpus=1, shuffle_partitions=1)
entry.queries()["later_answers"](spark, sys.argv[1]).write.parquet(sys.argv[1] + "/out")
"""


def test_later_answers_of_a_long_sample_fit_a_small_heap(tmp_path):
    """Texts of megabytes, some 0.8 GB in all, behind many short ones, in a heap of 512 MB."""
    n = 600
    answers = [f"{i} " + "word " * 900 for i in range(n)]
    rows = [{"sample_id": "a", "slot_id": i, "start": float(i), "gt_answer": a} for i, a in enumerate(answers)]
    rows += [{"sample_id": f"b{k}", "slot_id": 1, "start": 0.0, "gt_answer": "alone"} for k in range(5000)]
    rows = [{"slot_uid": u, "scene_type": "multi_turn", "updated_at": 0} | r | {"t_a": r["start"] + 0.25, "end": r["start"] + 0.5} for u, r in enumerate(rows)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "slots.parquet")
    repo = Path(__file__).resolve().parents[1]
    ran = subprocess.run([sys.executable, "-c", WRITE, str(tmp_path)], cwd=repo, env=os.environ | {"CADENZA_DRIVER_MEMORY": "512m", "PYTHONPATH": str(repo)}, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    lines = [f"- slot {i}: {a}" for i, a in enumerate(answers)]
    whole, at, seen = "\n".join(lines), [0], set()
    for line in lines:
        at.append(at[-1] + len(line) + 1)
    for part in sorted((tmp_path / "out").glob("*.parquet")):
        for batch in pq.ParquetFile(part).iter_batches(batch_size=16):
            for r in batch.to_pylist():
                assert r["later"] == (whole[at[r["slot_id"] + 1] :] if r["sample_id"] == "a" and r["slot_id"] < n - 1 else "(none)")
                seen.add((r["sample_id"], r["slot_id"]))
    assert seen == {(r["sample_id"], r["slot_id"]) for r in rows}
