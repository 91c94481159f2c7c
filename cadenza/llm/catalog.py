"""The modules whose queries ``__spark_entry__`` adds."""

from __future__ import annotations

import importlib

NAMES = ("p1_percentiles", "p2_pairs", "p4_runs", "p5_nearest", "p6_packing", "p7_mixing", "p8_pii")


def modules() -> list:
    return [importlib.import_module(f"cadenza.llm.queries.{n}") for n in NAMES]
