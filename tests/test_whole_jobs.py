"""Queries do the whole job: small tables with what a cut would leave out."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def test_later_answers_lists_all_later_slots(spark, tmp_path):
    n = 600
    slots = [(f"u{i}", "a", i, float(i), "one" if i % 3 else None, None if i % 50 == 0 else f"answer {i}") for i in range(n)]
    slots += [("v", "b", 1, 0.0, "one", "alone")]
    names = ["slot_uid", "sample_id", "slot_id", "start", "scene_type", "gt_answer"]
    rows = [dict(zip(names, s, strict=True)) | {"t_a": s[3] + 0.25, "end": s[3] + 0.5, "updated_at": 0} for s in slots]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "slots.parquet")
    got = {(r["sample_id"], r["slot_id"]): r["later"] for r in entry.queries()["later_answers"](spark, str(tmp_path)).collect()}
    want = {}
    for _, sample, i, _, scene, _ in slots:
        later = [f"- slot {j}: {a or ''}" for _, s, j, _, c, a in slots if s == sample and c == scene and j > i]
        want[sample, i] = "\n".join(later) or "(none)"
    assert got == want


def test_normalized_text_reads_all_languages(spark, tmp_path):
    docs = [(1, "A b!", "en"), (2, "ＡＢ１二三", "zh"), (3, "Été 4", "fr"), (4, "über", None), (5, "x y z", "und"), (6, None, "zh"), (7, "…", "es")]
    pq.write_table(pa.table({"doc_id": [d[0] for d in docs], "text": pa.array([d[1] for d in docs], pa.string()), "lang": pa.array([d[2] for d in docs], pa.string())}), tmp_path / "documents.parquet")
    got = {r["doc_id"]: r["n_letters"] for r in entry.queries()["normalized_text"](spark, str(tmp_path)).collect()}
    assert got == {1: 2, 2: 5, 3: 4, 4: 4, 5: 3, 6: None, 7: 0}


def test_steps_and_phrases_finds_a_number_anywhere(spark, tmp_path):
    texts = ["a" * 5000 + " 42 and 7", "b" * 1998 + " 12345.5", "3 first", "none", None]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), tmp_path / "documents.parquet")
    got = {r["doc_id"]: r["first_number"] for r in entry.queries()["steps_and_phrases"](spark, str(tmp_path)).collect()}
    assert got == {0: 42.0, 1: 12345.5, 2: 3.0, 3: None}


def test_touching_segments_uses_all_lines(spark, tmp_path):
    lines = [(1, n) for n in (1, 2, 3, 4, 5, 6, 7, 7)] + [(2, n) for n in (1, 4, 5, 8)]
    pq.write_table(pa.table({"l_orderkey": [x[0] for x in lines], "l_linenumber": [x[1] for x in lines]}), tmp_path / "lineitem.parquet")
    got = {tuple(r[c] for c in ("l_orderkey", "low", "high", "n")) for r in entry.queries()["touching_segments"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 8, 7), (2, 1, 2, 1), (2, 4, 6, 2), (2, 8, 9, 1)}
