"""Mixing sources to target shares of the total size, by Pareto order sampling.

Every record of a source has an expected number of copies, in proportion to its weight and at most the
source's cap. The whole part of it is certain. The rest is an inclusion probability p, and records are
ranked by the random odds u / (1 - u) over their odds p / (1 - p): the first of that order, up to the
size still missing, are a sample of fixed size with (very nearly) these unequal probabilities.

The order is never sorted as a whole. Sizes are summed per narrow class of rank, the class in which the
target is met is found from these sums, and only records of that class are ordered one by one. Where the
next record of the order is too large for what is missing, it is passed over and the order goes on with
those that fit, until a source is within TOLERANCE of its target or no record of it fits any more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import cut_lineage

#: Rank classes per unit of log odds, and the log odds beyond which ranks share a class.
PER_UNIT, FARTHEST = 256, 40
#: A source this near to its target, as a part of it, is done.
TOLERANCE = 0.002
#: Times the order is gone on with after a record that is too large.
PASSES = 12
#: Weight of a record whose own is NULL or not positive.
LEAST_WEIGHT = 0.001


@dataclass
class _Source:
    share: float
    cap: int
    sizes: dict[float, int]  # weight -> size of the records that have it

    def total(self, c: float) -> float:
        return sum(min(c * w, self.cap) * s for w, s in self.sizes.items())

    def factor(self, target: float) -> float:
        """c for which min(c * weight, cap) copies of everything are ``target`` in size."""
        low, high = 0.0, self.cap / min(self.sizes)
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if self.total(middle) < target else (low, middle)
        return high


def mix(records: DataFrame, targets: DataFrame, ident: str, source: str, size: Column | str, weight: Column | None = None, total: float | None = None, seed: int = 17) -> DataFrame:
    """Rows (<ident>, source, size, copies) of the mix, copies >= 1.

    ``targets`` has source, target_share, max_repeats; it is a parameter, of a row per source. ``total``
    is the size of the mix; by default, and at most, the largest at which no source needs more than its
    cap. Weights are positive, 1 unless given, and kept exactly: the driver reads a sum per distinct weight,
    of which 1/n for n copies has at most about sqrt(2 N) among N records.

    Defined results: records of a NULL or unlisted source, and of a size that is NULL or not positive,
    are not in the mix; a source without records, or with a share of 0, gives nothing and the others
    keep their proportions; a NULL or non-positive weight counts as LEAST_WEIGHT; equal ranks are told
    apart by ident; a repeated ident counts as often as it occurs; an empty table gives no rows.
    """
    spark = records.sparkSession
    w = F.lit(1.0) if weight is None else F.when(weight.cast("double") > 0, weight.cast("double")).otherwise(F.lit(LEAST_WEIGHT))
    listed = F.broadcast(targets.select(F.col("source").alias("__source"), F.col("target_share").cast("double").alias("__share"), F.col("max_repeats").alias("__cap")).filter("__share > 0 AND __cap > 0"))
    rows = records.select(F.col(ident).alias("item"), F.col(source).alias("__source"), (F.col(size) if isinstance(size, str) else size).cast("bigint").alias("size"), w.alias("weight"))
    rows = cut_lineage(rows.filter("size > 0").join(listed, "__source"))

    found: dict[str, _Source] = {}
    for r in rows.groupBy("__source", "__share", "__cap", "weight").agg(F.sum("size").alias("size")).toLocalIterator():
        s = found.setdefault(r["__source"], _Source(r["__share"], r["__cap"], {}))
        s.sizes[r["weight"]] = r["size"]
    # The largest mix is the one at which the first source is used up.
    most = min((s.cap * sum(s.sizes.values()) / s.share for s in found.values()), default=0.0)
    most = most if total is None else min(most, total)
    plan = [(k, s.factor(s.share * most), s.share * most) for k, s in found.items()]
    plan_rows = F.broadcast(spark.createDataFrame(plan, "__source string, __factor double, __target double"))

    expected = F.least(F.col("__factor") * F.col("weight"), F.col("__cap").cast("double"))
    u = (F.pmod(F.xxhash64(F.col("item"), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    sampled = (
        rows.join(plan_rows, "__source")
        .withColumn("whole", F.floor(expected + 1e-9))
        .withColumn("p", F.greatest(expected - F.col("whole"), F.lit(0.0)))
        .withColumn("u", u)
    )
    odds = F.log(F.col("u") / (1 - F.col("u"))) - F.log(F.col("p") / (1 - F.col("p")))
    sampled = sampled.withColumn("rank", F.when(F.col("p") > 1e-9, odds))
    near = F.greatest(F.least(F.col("rank"), F.lit(FARTHEST)), F.lit(-FARTHEST))
    sampled = sampled.withColumn("class", F.when(F.col("rank").isNotNull(), F.floor(near * PER_UNIT)))

    certain = {r["__source"]: r["certain"] or 0 for r in sampled.groupBy("__source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain")).collect()}  # a row per source
    taken = _taken(cut_lineage(sampled.filter("rank IS NOT NULL").select("__source", "item", "size", "class", "rank")), {k: (target - certain.get(k, 0), target) for k, _, target in plan})
    out = sampled.join(F.broadcast(taken), "__source", "left").withColumn("taken", F.col("rank").isNotNull() & F.coalesce(F.exists("cuts", lambda c: _within(c)), F.lit(False)))
    out = out.withColumn("copies", (F.col("whole") + F.col("taken").cast("int")).cast("int"))
    return out.filter("copies > 0").select(F.col("item").alias(ident), F.col("__source").alias(source), "size", "copies")


def _within(cut: Column) -> Column:
    """Whether a record lies in a stretch of the order, and fits what was missing there."""
    place = F.struct("rank", "item")
    return (F.col("size") <= cut["fits"]) & (cut["after"].isNull() | (place > cut["after"])) & (cut["upto"].isNull() | (place <= cut["upto"]))


def _taken(ranked: DataFrame, missing: dict[str, tuple[float, float]]) -> DataFrame:
    """(__source, cuts): the stretches of each source's order that are in the sample, one for every pass. A
    stretch holds the records that fit ``fits``, after the place ``after`` and up to ``upto``; no place is no
    bound. There are at most PASSES + 1 of them a source, whatever the number of records.
    """
    spark = ranked.sparkSession
    types = ranked.schema
    place = f"struct<rank:double,item:{types['item'].dataType.simpleString()}>"
    by_source = Window.partitionBy("__source")
    running = by_source.orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    cuts: dict[str, list[tuple]] = {k: [] for k in missing}
    left = {k: m for k, (m, _) in missing.items()}
    after: dict[str, object] = dict.fromkeys(missing)
    open_ = {k for k, (m, target) in missing.items() if m > TOLERANCE * target}
    for _ in range(PASSES):
        if not open_:
            break
        bounds = F.broadcast(spark.createDataFrame([(k, float(left[k]), after[k]) for k in open_], f"__source string, fits double, after {place}"))
        fitting = ranked.join(bounds, "__source").filter((F.col("size") <= F.col("fits")) & (F.col("after").isNull() | (F.struct("rank", "item") > F.col("after"))))
        # Classes are bounded by their number, 2 * FARTHEST * PER_UNIT a source, whatever the input.
        sums = fitting.groupBy("__source", "class", "fits").agg(F.sum("size").alias("size"), F.max(F.struct("rank", "item")).alias("last"))
        sums = sums.withColumn("upto", F.sum("size").over(running))
        whole = sums.groupBy("__source").agg(F.max(F.when(F.col("upto") <= F.col("fits"), F.struct("class", "upto", "last"))).alias("all_in"), F.min(F.when(F.col("upto") > F.col("fits"), F.col("class"))).alias("edge"))
        edges = [r.asDict(recursive=True) for r in whole.collect()]  # a row per source
        edge = F.broadcast(spark.createDataFrame([(e["__source"], e["edge"], float(e["all_in"]["upto"] if e["all_in"] else 0)) for e in edges if e["edge"] is not None], "__source string, class bigint, before double"))
        one_by_one = Window.partitionBy("__source", "class").orderBy("rank", "item")  # equal places together
        inside = fitting.join(edge, ["__source", "class"]).withColumn("upto", F.col("before") + F.sum("size").over(one_by_one)).filter(F.col("upto") <= F.col("fits"))
        found = {r["__source"]: r for r in inside.groupBy("__source").agg(F.max(F.struct("rank", "item")).alias("last"), F.max("upto").alias("upto")).collect()}  # a row per source
        seen = {e["__source"] for e in edges}
        for e in edges:
            k = e["__source"]
            last, size = (found[k]["last"], found[k]["upto"]) if k in found else (e["all_in"]["last"], e["all_in"]["upto"]) if e["all_in"] else (None, 0)
            if last is not None:
                last = tuple(last.values()) if isinstance(last, dict) else tuple(last)
                cuts[k].append((float(left[k]), after[k], last))
                left[k] -= size
                after[k] = last
            if e["edge"] is None or left[k] <= TOLERANCE * missing[k][1]:
                open_.discard(k)
        open_ &= seen
    rows = [(k, c) for k, c in cuts.items() if c]
    return spark.createDataFrame(rows, f"__source string, cuts array<struct<fits:double,after:{place},upto:{place}>>")


def shares(mixed: DataFrame, targets: DataFrame, source: str) -> DataFrame:
    """source, target_share, reachable_share, n_records, n_copies, most_copies, size, actual_share for every
    target; the reachable share is the target without those of sources that have no record at all."""
    got = mixed.groupBy(source).agg(F.count(F.lit(1)).alias("n_records"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("size")).alias("size"))
    table = targets.select(F.col("source").alias(source), "target_share", "max_repeats").join(got, source, "left").fillna(0, ["n_records", "n_copies", "most_copies", "size"])
    whole = F.sum("size").over(Window.partitionBy())  # a row per target
    there = F.when((F.col("size") > 0), F.col("target_share")).otherwise(0.0)
    table = table.withColumn("reachable_share", there / F.sum(there).over(Window.partitionBy()))
    return table.withColumn("actual_share", F.when(whole > 0, F.col("size") / whole).otherwise(0.0))
