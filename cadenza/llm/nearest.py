"""Pairing each record of one table with the nearest in time of another, through x-fast tries.

An x-fast trie over b-bit times is a stack of b + 1 hash tables, the l-th holding the first l bits of
every time with the range of times below it. The longest prefix a query shares with the trie is found
by binary search over l, in log b look-ups, and gives predecessor and successor at once. Here the
tries of all entities of a batch are built and asked together: the entity is the leading part of
every prefix.

Work is cut by (group, stretch of time), so a group that holds a third of all rows is many tasks'
work. Candidates near the edge of a stretch go to both sides of it, the queries to one only; each
query is therefore answered once, and no second pass chooses between answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scalars import is_time, ticks

#: Bits of a time within a stretch: 2**20 ticks, of which the tolerance is taken off at either end.
BITS = 20
#: Rows gathered before the tries of the complete stretches among them are built.
ROWS = 60_000


class XFastTries:
    """x-fast tries of many entities; ``entity`` and ``time`` are int64, sorted and distinct as pairs."""

    def __init__(self, entity: np.ndarray, time: np.ndarray, bits: int = BITS) -> None:
        self.bits = bits
        self.leaves = (entity << bits) | time
        self.levels = []
        for length in range(bits + 1):
            prefix = self.leaves >> (bits - length)
            first = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1]))) if len(prefix) else np.zeros(0, int)
            last = np.append(first[1:], len(prefix)) - 1 if len(prefix) else first
            self.levels.append((pd.Index(prefix[first]), first, last))

    def neighbours(self, entity: np.ndarray, time: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the last leaf <= time and of the first >= time of the entity, -1 for none."""
        key = (entity << self.bits) | time
        low = np.full(len(key), -1)  # longest length known to be in the trie; -1: not even the entity
        high = np.full(len(key), self.bits)
        node = np.full(len(key), -1)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_] + 1) // 2
            for length in np.unique(middle):
                at = open_[middle == length]
                found = self.levels[length][0].get_indexer(key[at] >> (self.bits - length))
                hit = found >= 0
                low[at[hit]], node[at[hit]] = length, found[hit]
                high[at[~hit]] = length - 1
        before = np.full(len(key), -1)
        after = np.full(len(key), -1)
        for length in np.unique(low[low >= 0]):
            at = np.flatnonzero(low == length)
            first, last = self.levels[length][1][node[at]], self.levels[length][2][node[at]]
            if length == self.bits:
                before[at] = after[at] = first
                continue
            up = (key[at] >> (self.bits - length - 1)) & 1 == 1  # the branch not taken is the lower one
            before[at] = np.where(up, last, first - 1)
            after[at] = np.where(up, last + 1, first)
        n = len(self.leaves)
        for side in (before, after):
            side[(side < 0) | (side >= n)] = -1
            ok = side >= 0
            ok[ok] = self.leaves[side[ok]] >> self.bits == entity[ok]
            side[~ok] = -1
        return before, after


def _answer(rows: pa.Table, stretch: int, tolerance: int, schema: pa.Schema) -> pa.RecordBatch:
    """The answers to all queries of some complete (group, stretch)s, sorted by these."""
    group_code = rows["grp"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    stretches = rows["stretch"].to_numpy()
    changed = (group_code[1:] != group_code[:-1]) | (stretches[1:] != stretches[:-1])
    group = np.concatenate(([0], np.cumsum(changed))).astype(np.int64)
    labels = rows["label"].combine_chunks().dictionary_encode()
    label = labels.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    time = rows["tick"].to_numpy() - (stretches * stretch - tolerance)
    identity = rows["id"].to_numpy()
    is_query = rows["is_query"].to_numpy(zero_copy_only=False)

    c = np.flatnonzero(~is_query)
    width = len(labels.dictionary)
    entity = group[c] * width + label[c]
    order = np.lexsort((time[c], entity))
    c, entity = c[order], entity[order]
    tries = XFastTries(entity, time[c])

    q = np.flatnonzero(is_query)
    present = np.unique(entity)
    low, high = np.searchsorted(present, group[q] * width), np.searchsorted(present, (group[q] + 1) * width)
    times = high - low
    each = np.repeat(np.arange(len(q)), times)
    asked = present[np.repeat(low, times) + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)]
    when = time[q][each]
    before, after = tries.neighbours(asked, when)
    far = np.int64(1) << 62
    distance = lambda p: np.where(p >= 0, np.abs(time[c][p] - when), far) if len(c) else np.full(len(p), far)
    name = lambda p: np.where(p >= 0, identity[c][p], far) if len(c) else np.full(len(p), far)
    d0, d1 = distance(before), distance(after)
    take_after = (d1 < d0) | ((d1 == d0) & (name(after) < name(before)))
    best, chosen = np.where(take_after, d1, d0), np.where(take_after, after, before)
    ok = np.flatnonzero(best <= tolerance)
    queries, candidates = q[each[ok]], c[chosen[ok]] if len(c) else q[:0]
    return pa.RecordBatch.from_arrays(
        [
            rows["label"].take(queries).combine_chunks(),
            rows["label"].take(candidates).combine_chunks(),
            rows["grp"].take(queries).combine_chunks(),
            rows["id"].take(queries).combine_chunks(),
            rows["id"].take(candidates).combine_chunks(),
            pa.array(time[candidates] - time[queries], pa.int64()),
        ],
        schema=schema,
    )


def nearest_in_time(
    queries: DataFrame,
    candidates: DataFrame,
    group: str,
    query: tuple[Column, Column, Column],
    candidate: tuple[Column, Column, Column],
    tolerance: float,
    per_second: int = 1000,
) -> DataFrame:
    """For each query and each label of candidates of its group, the candidate nearest in time.

    ``query`` and ``candidate`` are (label, id, seconds); label a string, id a whole number. Rows:
    query_label, label, <group>, query_id, id, delta (candidate - query, in ticks).

    Defined results: times are rounded to ticks (milliseconds by default); a distance of exactly the
    tolerance still counts; of equally near candidates the smallest id wins; repeated rows count
    once; rows whose group, label, id or time is NULL, NaN or infinite are left out; a query without
    a candidate near enough gives no row; an empty table gives none; columns of the tables that are
    not named here are ignored, so their names cannot clash.
    """
    near = int(tolerance * per_second + 0.5)
    stretch = (1 << BITS) - 2 * near - 1
    if stretch <= near:
        raise ValueError("the tolerance is too long for this tick")

    def rows(df: DataFrame, parts: tuple[Column, Column, Column], is_query: bool) -> DataFrame:
        label, identity, seconds = parts
        df = df.select(F.col(group).alias("grp"), label.alias("label"), identity.cast("bigint").alias("id"), seconds.cast("double").alias("__t"))
        df = df.filter(is_time("__t")).dropna().withColumn("tick", ticks("__t", per_second))
        at = lambda shift: F.floor((F.col("tick") + shift) / F.lit(stretch))
        if is_query:
            return df.select("grp", at(0).alias("stretch"), F.lit(True).alias("is_query"), "label", "tick", "id").distinct()
        df = df.select("grp", F.explode(F.sequence(at(-near), at(near))).alias("stretch"), "label", "tick", "id")
        # Equal times of one label become one row before anything is gathered: a stretch then has at most one per tick.
        df = df.groupBy("grp", "stretch", "label", "tick").agg(F.min("id").alias("id"))
        return df.select("grp", "stretch", F.lit(False).alias("is_query"), "label", "tick", "id")

    schema = pa.schema([("query_label", pa.string()), ("label", pa.string()), (group, pa.string()), ("query_id", pa.int64()), ("id", pa.int64()), ("delta", pa.int64())])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < ROWS:
                continue
            table = pa.Table.from_batches(held)
            # Everything before the last (group, stretch) is complete.
            g, s = table["grp"].to_pandas().to_numpy(), table["stretch"].to_numpy()
            other = np.flatnonzero((g != g[-1]) | (s != s[-1]))
            if not len(other):
                continue
            cut = int(other[-1]) + 1
            yield _answer(table.slice(0, cut), stretch, near, schema)
            held = table.slice(cut).combine_chunks().to_batches()
            n = table.num_rows - cut
        if n:
            yield _answer(pa.Table.from_batches(held), stretch, near, schema)

    both = rows(candidates, candidate, False).unionByName(rows(queries, query, True))
    together = both.repartition("grp", "stretch").sortWithinPartitions("grp", "stretch")
    return together.mapInArrow(answers, f"query_label string, label string, `{group}` string, query_id bigint, id bigint, delta bigint")
