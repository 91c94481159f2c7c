"""Every query of the core with SQL gives the same rows as DuckDB; the others run."""

from __future__ import annotations

import importlib

import pytest

import __spark_entry__ as entry
from tests.compare import DATA, connection, same

MODULES = [importlib.import_module(m) for m in entry.CORE]
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLES = {n: s for m in MODULES for n, s in m.ORACLES.items()}


@pytest.fixture(scope="module")
def con():
    return connection()


def test_names_belong_together():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    same(spark, con, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["track", "model_name", "sample_id", "kind", "start_ms", "end_ms"]
