"""Packing items of varying size into containers of fixed capacity, by patterns fitted to the histogram.

The plan is made from the histogram of sizes alone, which has at most one entry per size up to the
capacity and so a bound that does not depend on the data. Patterns of a few sizes that fill a
container are enumerated; how often each is used comes from a non-negative least-squares fit to the
histogram, rounded down. What is left of the histogram, above all items small against the capacity, is
packed in patterns that start with the largest size left and end in one, two or three sizes that fill
the room best. A pattern is used as often as its sizes last, so their number follows that of sizes.

Documents never come to the driver. A document's rank among those of its size picks its place in the
plan by binary search, and ranks are numbered by (size, slice of documents), so a size that a third of
all documents share is many tasks' work.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.session import cut_lineage

#: Sizes are grouped so that a capacity has so many size classes while patterns are fitted.
CLASSES = 128
#: Residual patterns end in three sizes, the first of them out of so many spread over those that fit.
TRIED = 12
#: Slices of documents numbered apart.
SLICES = 256


@dataclass
class Plan:
    """Which container the r-th item of each size goes to.

    ``first[size]`` are sorted ranks, ``base[size]`` and ``per[size]`` what they stand for: item r, in
    the last interval that starts at or before it, goes to container base + (r - first) // per.
    """

    capacity: int
    n: int = 0
    first: dict[int, list[int]] = field(default_factory=dict)
    base: dict[int, list[int]] = field(default_factory=dict)
    per: dict[int, list[int]] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=dict)

    def add(self, sizes: dict[int, int], times: int) -> None:
        """``times`` containers, each of ``sizes[s]`` items of size s."""
        for s, k in sizes.items():
            self.first.setdefault(s, []).append(self.used.get(s, 0))
            self.base.setdefault(s, []).append(self.n)
            self.per.setdefault(s, []).append(k)
            self.used[s] = self.used.get(s, 0) + k * times
        self.n += times

    def locate(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.empty(len(size), dtype=np.int64)
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            first = np.array(self.first[int(s)])
            i = np.searchsorted(first, rank[at], side="right") - 1
            out[at] = np.array(self.base[int(s)])[i] + (rank[at] - first[i]) // np.array(self.per[int(s)])[i]
        return out


def patterns(n_classes: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """Multisets of one to three of the present classes (class c: sizes up to c / n of the capacity) that fill n."""
    have = set(present.tolist())
    out = [(n_classes,)] if n_classes in have else []
    for a in present:
        for b in present[present <= a]:
            if (rest := n_classes - a - b) == 0:
                out.append((int(a), int(b)))
            elif 0 < rest <= b and rest in have:
                out.append((int(a), int(b), int(rest)))
    return out


def fit_nonnegative(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with a x near b in least squares, by accelerated projected gradients."""
    if not a.size:
        return np.zeros(a.shape[1])
    ata, atb = a.T @ a, a.T @ b
    probe = np.ones(len(ata))
    for _ in range(30):
        probe = ata @ probe
        probe /= np.linalg.norm(probe)
    step = 1 / (probe @ ata @ probe * 1.05)
    x = y = np.zeros(len(atb))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (ata @ y - atb))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def _best_end(sizes: np.ndarray, room: int) -> tuple[int, tuple[int, ...]]:
    """(room that stays free, sizes) of one to three of ``sizes`` (ascending) that fill ``room`` best."""
    fit = sizes[: np.searchsorted(sizes, room, side="right")]
    if not len(fit):
        return room, ()
    best = (room - int(fit[-1]), (int(fit[-1]),))
    for lead in (0, *fit[:: max(1, len(fit) // TRIED)].tolist()):
        # With ``lead`` in place (0: nothing), each other size and the largest that still fits beside it.
        inside = room - lead
        x = fit[: np.searchsorted(fit, inside, side="right")]
        at = np.searchsorted(fit, inside - x, side="right") - 1
        x, at = x[at >= 0], at[at >= 0]
        if not len(x):
            continue
        free = inside - x - fit[at]
        i = int(np.argmin(free))
        if free[i] < best[0]:
            best = (int(free[i]), tuple(v for v in (int(lead), int(x[i]), int(fit[at[i]])) if v))
        if best[0] == 0:
            break
    return best


def _pack(left: dict[int, int], plan: Plan) -> None:
    """All that is left in ``left``, by patterns that start with the largest size."""
    sizes = np.array(sorted(left), dtype=np.int64)
    while left:
        sizes = sizes[[int(s) in left for s in sizes]] if len(sizes) != len(left) else sizes
        room, chosen = plan.capacity, []
        best: tuple[int, list[int]] | None = None
        while room >= sizes[0]:
            if chosen and room <= 4 * int(sizes[-1]) or room == plan.capacity and len(sizes) == 1:
                free, end = _best_end(sizes, room)
                if best is None or free < best[0]:
                    best = (free, [*chosen, *end])
                if best[0] == 0:
                    break
            s = int(sizes[np.searchsorted(sizes, room, side="right") - 1])
            # Many of the largest at once while there is room for more than the end needs.
            k = max(1, (room - 3 * s) // s) if chosen or s * 4 < room else 1
            chosen += [s] * k
            room -= s * k
        if best is None or room < best[0]:
            best = (room, chosen)
        pattern: dict[int, int] = {}
        for s in best[1]:
            pattern[s] = pattern.get(s, 0) + 1
        if any(k > left[s] for s, k in pattern.items()):  # the last few: as many as there are
            pattern = {s: min(k, left[s]) for s, k in pattern.items()}
            room = plan.capacity - sum(s * k for s, k in pattern.items())
            for s in sizes[::-1].tolist():
                if s <= room and (k := min(left[s] - pattern.get(s, 0), room // s)) > 0:
                    pattern[s] = pattern.get(s, 0) + k
                    room -= k * s
        times = min(left[s] // k for s, k in pattern.items())
        plan.add(pattern, times)
        for s, k in pattern.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]


def make_plan(histogram: dict[int, int], capacity: int, classes: int = CLASSES) -> Plan:
    """A plan for ``histogram`` (size -> items, 1 <= size <= capacity)."""
    plan = Plan(capacity)
    left = {s: n for s, n in histogram.items() if n}
    if not left:
        return plan
    width = max(1, capacity // classes)
    n_classes = capacity // width
    # A class holds the sizes up to its upper end, so a pattern of classes never overflows.
    members: dict[int, list[int]] = {}
    for s in sorted(left, reverse=True):
        members.setdefault(-(-s // width), []).append(s)
    members = {c: m for c, m in members.items() if c <= n_classes}
    present = np.array(sorted(members))
    tried = patterns(n_classes, present)
    if tried:
        row = {c: i for i, c in enumerate(present.tolist())}
        a = np.zeros((len(present), len(tried)))
        for j, p in enumerate(tried):
            for c in p:
                a[row[c], j] += 1
        b = np.array([sum(left[s] for s in members[c]) for c in present.tolist()], dtype=float)
        weight = np.where(present > n_classes // 8, 1.0, 0.1)  # small ones find a place later anyhow
        uses = np.floor(fit_nonnegative(a * weight[:, None], b * weight) + 1e-9).astype(np.int64)
        for j in np.argsort(-uses):
            todo = int(uses[j])
            while todo > 0:
                # The largest member of each class that is left, as often as all of them last.
                chosen: dict[int, int] = {}
                for c in tried[j]:
                    s = next((s for s in members[c] if left.get(s, 0) > chosen.get(s, 0)), None)
                    if s is None:
                        break
                    chosen[s] = chosen.get(s, 0) + 1
                else:
                    room = capacity - sum(s * k for s, k in chosen.items())
                    if room:  # what the classes leave open is filled exactly, if a size of that kind is left
                        exact = next((r for r in range(room, max(0, room - width), -1) if left.get(r, 0) > chosen.get(r, 0)), None)
                        if exact:
                            chosen[exact] = chosen.get(exact, 0) + 1
                    times = min(todo, *(left[s] // k for s, k in chosen.items()))
                    plan.add(chosen, times)
                    for s, k in chosen.items():
                        left[s] -= k * times
                        if not left[s]:
                            del left[s]
                    todo -= times
                    continue
                break
    _pack(left, plan)
    return plan


def pack(items: DataFrame, ident: str, size: Column | str, capacities: dict[str, int], slices: int = SLICES) -> DataFrame:
    """Assign every item to a container of each kind.

    Rows: container_kind, container_id, <ident>, part, token_start, n_tokens, capacity_tokens. Only items
    larger than the capacity are divided: into parts of a whole capacity, a container each, and a last
    part that is packed like any item. What a container has left is its capacity less the sum of its
    n_tokens (``unused_room``).

    Defined results: an item of size 0, negative or NULL needs no room and comes out once per kind with
    container_id NULL and n_tokens 0; a repeated ident is packed as often as it occurs; equal sizes are
    told apart by ident; an empty table gives no rows; other columns are ignored.
    """
    spark = items.sparkSession
    sized = items.select(F.col(ident).alias("item"), F.greatest(F.coalesce(F.col(size) if isinstance(size, str) else size, F.lit(0)), F.lit(0)).cast("bigint").alias("total"))
    # The sizes cost the most and are read twice: once for the histogram, once for the places.
    sized = cut_lineage(sized.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(slices)).cast("int")))
    # The few kinds (a parameter) go to every item, as an array and not as a join.
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(int(c)).alias("capacity_tokens")) for k, c in sorted(capacities.items())]))
    every = sized.select("item", "total", "slice", each.alias("k")).select("item", "total", "slice", "k.*")
    parts = every.withColumn("rest", F.col("total") % F.col("capacity_tokens")).withColumn("whole", F.floor(F.col("total") / F.col("capacity_tokens")))
    packed = parts.filter("rest > 0")
    counts = packed.groupBy("container_kind", "rest", "slice").count()
    histogram = counts.groupBy("container_kind", "rest").agg(F.sum("count").alias("n"))

    plans: dict[str, Plan] = {}
    sizes: dict[str, dict[int, int]] = {k: {} for k in capacities}
    for r in histogram.toLocalIterator():  # at most one row per kind and size up to its capacity
        sizes[r["container_kind"]][r["rest"]] = r["n"]
    for kind, capacity in capacities.items():
        plans[kind] = make_plan(sizes[kind], int(capacity))

    before = Window.partitionBy("container_kind", "rest").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("container_kind", "rest", "slice").orderBy("item")
    ranked = packed.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["container_kind", "rest", "slice"]).withColumn("rank", F.col("rank") + F.col("offset"))

    sent = spark.sparkContext.broadcast(plans)  # bounded by the number of sizes, not of items

    def place(kind: pd.Series, rest: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.empty(len(kind), dtype=np.int64)
        for k in kind.unique():
            at = np.flatnonzero((kind == k).to_numpy())
            out[at] = sent.value[k].locate(rest.to_numpy()[at].astype(np.int64), rank.to_numpy()[at].astype(np.int64))
        return pd.Series(out)

    where = F.pandas_udf(place, T.LongType())
    name = F.col("item").alias(ident)
    last = ranked.select("container_kind", F.concat(F.lit("p"), where("container_kind", "rest", "rank").cast("string")).alias("container_id"), name, F.col("whole").cast("int").alias("part"), (F.col("whole") * F.col("capacity_tokens")).alias("token_start"), F.col("rest").alias("n_tokens"), "capacity_tokens")
    full = parts.filter("whole > 0").select("*", F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).alias("part"))
    full = full.select("container_kind", F.concat_ws("-", F.lit("w"), "item", "part").alias("container_id"), name, "part", (F.col("part").cast("bigint") * F.col("capacity_tokens")).alias("token_start"), F.col("capacity_tokens").cast("bigint").alias("n_tokens"), "capacity_tokens")
    nothing = parts.filter("total = 0").select("container_kind", F.lit(None).cast("string").alias("container_id"), name, F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("token_start"), F.lit(0).cast("bigint").alias("n_tokens"), "capacity_tokens")
    return last.unionByName(full).unionByName(nothing)


def unused_room(packed: DataFrame) -> DataFrame:
    """container_kind, container_id, n_parts, used, unused of every container."""
    return (
        packed.filter("container_id IS NOT NULL")
        .groupBy("container_kind", "container_id", "capacity_tokens")
        .agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n_tokens").alias("used_tokens"))
        .withColumn("unused_tokens", F.col("capacity_tokens") - F.col("used_tokens"))
    )
