"""Runs of identical or near-identical consecutive events, each collapsed into one event.

Boundary interval lookup: the events of an entity are read in order, the positions at which a run
starts are gathered into a sorted array, and every event finds its run by binary search in it.

An entity may hold a third of all events, so it is cut into blocks of consecutive ids, which are
worked on apart. A block gives its runs of two or more and, as something may continue there, its
first and last run. Only these edges, two rows a block at most, are then joined across blocks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids in a block. Rows are streamed through, so this sets how finely a hot entity is spread, not memory.
BLOCK = 16_384
#: Reduced texts from this length on may differ in one place and still be the same.
NEAR_FROM = 10

_DROPPED = re.compile(r"[\W_]+")
_NOT_DIGIT = re.compile(r"\D+")


def reduce_text(text: str | None) -> str:
    """Letters and digits alone, after NFKC and case folding; '' for NULL."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _DROPPED.sub("", text.casefold())


def nearly_same(a: str, b: str) -> bool:
    """Reduced texts that are equal, or of at least NEAR_FROM characters with the same digits and one
    wrong, missing or extra letter or two swapped neighbours between them."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if min(n, m) < NEAR_FROM or abs(n - m) > 1:
        return False
    i = next((k for k in range(min(n, m)) if a[k] != b[k]), min(n, m))
    if n == m:
        swapped = a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
        close = swapped or a[i + 1 :] == b[i + 1 :]
    else:
        close = a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]
    return close and _NOT_DIGIT.sub("", a) == _NOT_DIGIT.sub("", b)


class _Open:
    """The run still open where a batch ends."""

    def __init__(self, entity: tuple, first: int, last: int, n: int, low: float, high: float, head: str, tail: str, is_first: bool) -> None:
        self.entity, self.first, self.last, self.n = entity, first, last, n
        self.low, self.high, self.head, self.tail, self.is_first = low, high, head, tail, is_first


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches sorted by keys, block and id, to runs. What is held is one batch and one open run."""
    held: _Open | None = None
    seen: tuple | None = None  # entity and id of the last row read, of whatever text

    def row(r: _Open, is_last: bool) -> dict | None:
        if r.n < 2 and not (r.is_first or is_last):
            return None
        *names, block = r.entity
        edge = r.is_first or is_last
        out = dict(zip(keys, names, strict=True))
        return out | {"block": block, "first_id": r.first, "last_id": r.last, "n": r.n, "low": r.low, "high": r.high, "is_first": r.is_first, "is_last": is_last, "head": r.head if edge else None, "tail": r.tail if edge else None}

    for batch in batches:
        if not batch.num_rows:
            continue
        out: list[dict] = []
        names = [batch.column(k).to_pylist() if batch.num_rows < 2 else batch.column(k).dictionary_encode() for k in keys]
        codes = [pd.factorize(np.array(c, dtype=object))[0] if isinstance(c, list) else c.indices.to_numpy(zero_copy_only=False) for c in names]
        block, ident = batch.column("block").to_numpy(), batch.column("id").to_numpy()
        name_at = lambda i: tuple(c[i] if isinstance(c, list) else c.dictionary[int(k[i])].as_py() for c, k in zip(names, codes, strict=True))  # noqa: B023, E731
        moved = block[1:] != block[:-1]
        for code in codes:
            moved = moved | (code[1:] != code[:-1])
        group = np.concatenate(([0], np.cumsum(moved)))
        copy = np.concatenate(([False], ~moved & (ident[1:] == ident[:-1])))
        copy[0] = seen == (*name_at(0), int(block[0]), int(ident[0]))
        seen = (*name_at(-1), int(block[-1]), int(ident[-1]))

        distinct = batch.column("text").dictionary_encode()
        reduced_of = np.array([reduce_text(x) for x in distinct.dictionary.to_pylist()] + [""], dtype=object)
        at = distinct.indices.fill_null(len(reduced_of) - 1).to_numpy(zero_copy_only=False)
        reduced = reduced_of[at]
        keep = np.flatnonzero(~copy & (reduced != ""))
        if not len(keep):
            continue
        text_code = pd.factorize(reduced_of)[0][at][keep]
        texts, group_k, ids = reduced[keep], group[keep], ident[keep]
        low, high = (batch.column(c).to_numpy(zero_copy_only=False)[keep] for c in ("low", "high"))
        same_group = group_k[1:] == group_k[:-1]
        same = same_group & (text_code[1:] == text_code[:-1])
        length = np.array([len(x) for x in reduced_of])[at][keep]
        maybe = np.flatnonzero(same_group & ~same & (np.minimum(length[1:], length[:-1]) >= NEAR_FROM) & (np.abs(length[1:] - length[:-1]) <= 1))
        for i in maybe:
            same[i] = nearly_same(texts[i], texts[i + 1])

        head_entity = (*name_at(keep[0]), int(block[keep[0]]))
        joins = held is not None and held.entity == head_entity and nearly_same(held.tail, texts[0])
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        run_of = np.searchsorted(starts, np.arange(len(keep)), side="right") - 1
        ends = np.append(starts[1:], len(keep)) - 1
        count = np.bincount(run_of)
        lows, highs = np.fmin.reduceat(low, starts), np.fmax.reduceat(high, starts)
        new_group = np.concatenate(([True], ~same_group))[starts]
        if held is not None and held.entity == head_entity:
            new_group[0] = False
        ends_group = np.append(new_group[1:], False)
        if held is not None and not joins and (r := row(held, held.entity != head_entity)):
            out.append(r)
        want = (count >= 2) | new_group | ends_group
        want[[0, -1]] = True
        for i in np.flatnonzero(want):
            a, b = starts[i], ends[i]
            run = _Open((*name_at(keep[a]), int(block[keep[a]])), int(ids[a]), int(ids[b]), int(count[i]), lows[i], highs[i], texts[a], texts[b], bool(new_group[i]))
            if i == 0 and joins:
                run.first, run.head, run.is_first = held.first, held.head, held.is_first
                run.n, run.low, run.high = held.n + run.n, np.fmin(held.low, run.low), np.fmax(held.high, run.high)
            if i == len(starts) - 1:
                held = run
            elif r := row(run, bool(ends_group[i])):
                out.append(r)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held is not None and (r := row(held, True)):
        yield pa.RecordBatch.from_pylist([r], schema=schema)


@F.pandas_udf(T.BooleanType())
def _continues(tail: pd.Series, head: pd.Series) -> pd.Series:
    return pd.Series([a is not None and b is not None and nearly_same(a, b) for a, b in zip(tail, head, strict=True)], dtype=bool)


def collapse_runs(events: DataFrame, keys: list[str], ident: str, text: str, start: Column | None = None, end: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row per run: keys, first_id, last_id, n_events, start, end, duration.

    ``keys`` are string columns, ``ident`` gives the order and is a whole number. A run is a stretch
    of events each the same as the one before it: equal as ``reduce_text`` gives them, or near
    (``nearly_same``). Events without a letter or digit are passed over and break no run. Runs of one
    event are left to the caller's own rows: only runs of two or more come out.

    Defined results: a repeated (keys, ident) counts once; NULL and blank texts are passed over; a
    NULL key or ident leaves the row out; times are optional, missing ones are ignored, and a run
    without any has NULL times and duration; very long texts are compared whole; an empty table gives
    no rows; columns not named here are ignored.
    """
    nothing = F.lit(None).cast("double")
    rows = events.select(
        *keys,
        F.expr(f"CAST(`{ident}` AS BIGINT) DIV {int(block)}").alias("block"),  # in whole numbers: a double has 53 bits
        F.col(ident).cast("bigint").alias("id"),
        F.col(text).alias("text"),
        (nothing if start is None else start).alias("low"),
        (nothing if end is None else end).alias("high"),
    ).dropna(subset=[*keys, "id"])
    fields = [*((k, pa.string()) for k in keys), ("block", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("is_first", pa.bool_()), ("is_last", pa.bool_()), ("head", pa.string()), ("tail", pa.string())]
    schema = pa.schema(fields)
    spark_schema = ", ".join([*(f"`{k}` string" for k in keys), "block bigint, first_id bigint, last_id bigint, n bigint, low double, high double, is_first boolean, is_last boolean, head string, tail string"])
    in_order = rows.repartition(*keys, "block").sortWithinPartitions(*keys, "block", "id")
    # Every run twice below: those inside a block as they are, those at an edge joined to their neighbours.
    runs = in_order.mapInArrow(lambda batches: _runs(batches, keys, schema), spark_schema)

    inner = ~(F.col("is_first") | F.col("is_last"))
    entity = Window.partitionBy(*keys, "inner").orderBy("first_id")
    marked = runs.withColumn("inner", F.when(inner, F.col("first_id")))
    # An inner run is a partition of its own; the edges of an entity are one, of two rows a block.
    before = F.lag(F.struct("tail", "is_last", "block")).over(entity)
    may = F.col("is_first") & F.col("before.is_last") & (F.col("before.block") < F.col("block"))
    marked = marked.withColumn("before", before)
    marked = marked.withColumn("joins", F.col("inner").isNull() & F.coalesce(_continues(F.when(may, F.col("before.tail")), F.when(may, F.col("head"))), F.lit(False)))
    marked = marked.withColumn("run", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(entity))
    out = marked.groupBy(*keys, "inner", "run").agg(
        F.min("first_id").alias("first_id"),
        F.max("last_id").alias("last_id"),
        F.sum("n").alias("n_events"),
        F.min(F.nanvl("low", F.lit(None))).alias("start"),
        F.max(F.nanvl("high", F.lit(None))).alias("end"),
    )
    return out.filter(F.col("n_events") >= 2).select(*keys, "first_id", "last_id", "n_events", "start", "end", (F.col("end") - F.col("start")).alias("duration"))
