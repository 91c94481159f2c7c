"""Order-dependent operators over event series: islands, run lengths, running sums, recurrences.

All take rows with a key, an order and measures. A key may hold a third of all rows, so what runs along it is
cut into stretches of time: a window over each (key, stretch), and a row per stretch that carries sums, maxima
and last values from one to the next. What cannot be said so (a recurrence) is folded over the sorted pass in
Arrow batches with the carried state as the only memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Seconds of a key's time that one task sees at once.
STRETCH_S = 86_400.0


def stretch_of(time: str = "t", seconds: float = STRETCH_S) -> Column:
    """The number of the stretch a time in seconds lies in."""
    return F.floor(F.col(time) / seconds)


def running(rows: DataFrame, key: str, order: list[str], stretch: Column, before: bool = False, **measures: tuple[str, Column]) -> DataFrame:
    """Adds running measures along each key: ``name=("sum" | "max" | "last", column)``, ``last`` being the last value
    that is not NULL. Up to and with the row, or with ``before`` up to the row before it.

    ``stretch`` cuts a key along ``order`` (it must not fall along it). Rows meet only those of their stretch; a
    row per stretch is summed up first and carried to the later ones.
    """
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    cut = rows.withColumn("__st", stretch)
    place = F.struct(*order)
    total = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), place))}
    inside = Window.partitionBy(key, "__st").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.partitionBy(key).orderBy("__st").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    totals = cut.groupBy(key, "__st").agg(*[total[kind](c).alias(f"__t_{n}") for n, (kind, c) in measures.items()])
    carried = totals.select(key, "__st", *[over[kind](F.col(f"__t_{n}")).over(earlier).alias(f"__c_{n}") for n, (kind, _) in measures.items()])
    out = cut.join(carried, [key, "__st"])
    for n, (kind, c) in measures.items():
        own, carry = over[kind](c).over(inside), F.col(f"__c_{n}")
        both = {"sum": F.coalesce(own + carry, own, carry), "max": F.greatest(own, carry), "last": F.coalesce(own, carry)}[kind]
        out = out.withColumn(n, both)
    return out.drop("__st", *[f"__c_{n}" for n in measures])


def previous(rows: DataFrame, key: str, order: list[str], stretch: Column, **columns: Column) -> DataFrame:
    """Adds ``name``: a column of the row before, whatever its stretch; NULL for the first row of a key."""
    boxed = {f"__p_{n}": ("last", F.struct(c.alias("v"))) for n, c in columns.items()}
    out = running(rows, key, order, stretch, before=True, **boxed)
    for n in columns:
        out = out.withColumn(n, F.col(f"__p_{n}.v"))
    return out.drop(*boxed)


def islands(rows: DataFrame, key: str, order: list[str], is_break: Column, stretch: Column | None = None) -> DataFrame:
    """Adds ``island``: the number of breaks up to and with the row."""
    return running(rows, key, order, stretch_of(order[0]) if stretch is None else stretch, island=("sum", F.coalesce(is_break, F.lit(False)).cast("bigint")))


def speaking_islands(rows: DataFrame, key: str, order: list[str], speaking: Column) -> DataFrame:
    """Stretches of rows that speak, ended by any row that does not: first, last, number of rows."""
    cut = islands(rows.withColumn("__speaks", speaking), key, order, ~F.col("__speaks"))
    return cut.filter("__speaks").groupBy(key, "island").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n")).drop("island")


def merged_touching(rows: DataFrame, key: str, low: str, high: str, width: float = STRETCH_S) -> DataFrame:
    """Segments that begin where the one before ends, as one; ``width`` is that of a stretch."""
    marked = previous(rows, key, [low, high], stretch_of(low, width), __before=F.col(high))
    cut = islands(marked, key, [low, high], F.col("__before").isNull() | (F.col(low) != F.col("__before")), stretch_of(low, width))
    return cut.groupBy(key, "island").agg(F.min(low).alias(low), F.max(high).alias(high), F.count(F.lit(1)).alias("n")).drop("island")


def run_lengths(rows: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Runs of equal labels; a NULL label ends a run and makes none."""
    marked = previous(rows, key, order, stretch_of(order[0]), __before=F.col(label))
    cut = islands(marked, key, order, ~F.col("__before").eqNullSafe(F.col(label)))
    return cut.filter(F.col(label).isNotNull()).groupBy(key, "island", label).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n")).drop("island")


def bridged_runs(rows: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Runs of equal labels in which NULL labels between equal ones are absorbed."""
    return run_lengths(rows.filter(F.col(label).isNotNull()), key, order, label)


def proportional_times(rows: DataFrame, key: str, order: str, weight: Column, total: Column, digits: int = 3) -> DataFrame:
    """A duration shared out by weight, in order: start and end of every row, the last end being the total."""
    w = Window.partitionBy(key).orderBy(order)
    whole = Window.partitionBy(key)
    out = rows.withColumn("__w", weight).withColumn("__d", total)
    upto = F.sum("__w").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("__e", F.col("__d") * upto / F.sum("__w").over(whole)).withColumn("__s", F.col("__d") * (upto - F.col("__w")) / F.sum("__w").over(whole))
    last = F.lead(order).over(w).isNull()
    return out.withColumn("start", F.round(F.when(F.col("__d") > 0, F.col("__s")).otherwise(F.lit(0.0)), digits)).withColumn("end", F.round(F.when(F.col("__d") <= 0, F.lit(0.0)).when(last, F.col("__d")).otherwise(F.col("__e")), digits)).drop("__w", "__d", "__e", "__s")


def turn_index(rows: DataFrame, key: str, order: list[str], closes: Column) -> DataFrame:
    """Adds ``turn``: how many earlier rows closed a turn."""
    out = running(rows, key, order, stretch_of(order[0]), before=True, turn=("sum", closes.cast("bigint")))
    return out.withColumn("turn", F.coalesce("turn", F.lit(0)))


def laid_end_to_end(rows: DataFrame, key: str, order: list[str], length: Column) -> DataFrame:
    """Adds ``offset`` and ``end_offset`` of rows laid one after the other."""
    out = running(rows.withColumn("__n", length), key, order, stretch_of(order[0]), end_offset=("sum", F.col("__n")))
    return out.withColumn("offset", F.col("end_offset") - F.col("__n")).drop("__n")


def subtitles(rows: DataFrame, key: str, order: list[str], text: str, hold: float) -> DataFrame:
    """Text that grows within a turn; a line stays until the next begins, at the end of a turn ``hold`` more.

    The number of lines of a turn is what bounds a line's text; a line whose text the next only extends
    stays up to that one's start.
    """
    w = Window.partitionBy(key, "turn").orderBy(*order)
    grown = F.array_join(F.collect_list(text).over(w.rowsBetween(Window.unboundedPreceding, 0)), " ")
    nxt = F.lead("t").over(w)
    return rows.withColumn("line", grown).withColumn("shown_from", F.col("t")).withColumn("shown_to", F.coalesce(nxt, F.col("t") + hold))


def time_to_first(rows: DataFrame, key: str, order: list[str], speaking: Column) -> DataFrame:
    """For each row that speaks after one that listened: the time since that one."""
    flagged = rows.withColumn("__s", speaking)
    out = running(flagged, key, order, stretch_of(order[0]), before=True, __before=("last", F.struct(F.col("__s").alias("v"))), __heard=("last", F.when(~F.col("__s"), F.col("t"))))
    return out.filter(F.col("__s") & (F.col("__before.v") == F.lit(False))).withColumn("wait", F.col("t") - F.col("__heard")).drop("__s", "__before", "__heard")


def drift(rows: DataFrame, key: str, order: list[str], sent: str, received: str) -> DataFrame:
    """Adds ``drift``: how much later a row came than the first row of its key, by the sender's clock."""
    late = F.col(received) - F.col(sent)
    first = rows.groupBy(key).agg(F.min_by(late, F.when(late.isNotNull(), F.struct(*order))).alias("__first"))
    return rows.join(first, key).withColumn("drift", late - F.col("__first")).drop("__first")


def placed_without_overlap(rows: DataFrame, key: str, order: list[str], arrival: str, duration: str) -> DataFrame:
    """Adds ``start``, ``end`` and ``gap``: each row plays when it has come and the one before it is over.

    next = max(next, arrival) + duration, as a running maximum: with S the sum of durations up to a row,
    its end is S + max over rows so far of (arrival - sum of durations before).
    """
    out = running(rows, key, order, stretch_of(order[0]), __s=("sum", F.col(duration)))
    out = running(out, key, order, stretch_of(order[0]), __lead=("max", F.col(arrival) - (F.col("__s") - F.col(duration))))
    out = out.withColumn("end", F.col("__s") + F.col("__lead")).withColumn("start", F.col("end") - F.col(duration))
    out = previous(out, key, order, stretch_of(order[0]), __last_end=F.col("end"))
    return out.withColumn("gap", F.greatest(F.col("start") - F.col("__last_end"), F.lit(0.0))).drop("__s", "__lead", "__last_end")


def retained(rows: DataFrame, key: str, newest: list[str], age: str, size: str, capacity: float) -> DataFrame:
    """Adds ``kept``: from the newest on, rows are kept as long as all of them fit. ``newest`` are columns that
    rise from the newest row to the oldest, the first of them ``age`` in seconds."""
    return running(rows, key, newest, stretch_of(age), __held=("sum", F.col(size))).withColumn("kept", F.col("__held") <= capacity).drop("__held")


def blocks(rows: DataFrame, time: str, length: str, hop: str) -> DataFrame:
    """Each row once per overlapping block that holds it: ``block.start``, ``block.end``."""
    return rows.withColumn("block", F.window(time, length, hop))


def dominant(rows: DataFrame, keys: list[str], label: str, order: list[str]) -> DataFrame:
    """The most frequent label of a group; of equals the one seen first. Partial counts, no group gathered."""
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(*order)).alias("__first"))
    best = Window.partitionBy(*keys).orderBy(F.col("__n").desc(), F.col("__first").asc())
    return counts.withColumn("__rn", F.row_number().over(best)).filter("__rn = 1").select(*keys, label, F.col("__n").alias("n"))


def buckets(rows: DataFrame, keys: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """Rollup per bucket of time: count, sum, labels in order, first label."""
    piece = F.struct(*order, "event_type")
    return rows.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["event_type"]), " ").alias("labels"),
        F.min_by("event_type", F.struct(*order)).alias("first_label"),
    )


def dropped_after_interrupt(rows: DataFrame, key: str, order: list[str], interrupt: Column, group: str) -> DataFrame:
    """Rows without those that belong to a group already cut off by an interrupt, and without interrupts.

    The group cut off is that of the last row before the interrupt; a row of another group lifts the cut.
    """
    out = running(rows.withColumn("__i", interrupt), key, order, stretch_of(order[0]), before=True, __spoken=("last", F.when(~F.coalesce(interrupt, F.lit(False)), F.col(group))))
    # The group cut off by the last interrupt, and the last group heard since: the cut holds while that is the same.
    out = running(out, key, order, stretch_of(order[0]), before=True, __cut=("last", F.when(F.col("__i"), F.struct(F.col("__spoken").alias("g")))))
    return out.filter(~F.col("__i") & ~F.coalesce(F.col("__cut.g") == F.col(group), F.lit(False))).drop("__i", "__spoken", "__cut")


def folded(rows: DataFrame, key: str | list[str], order: list[str], inputs: list[str], start: Callable[[], object], step: Callable, output: str, kind: str = "double") -> DataFrame:
    """A recurrence over each key in order: ``state, out = step(state, *inputs)``; rows with ``output`` added.

    One sorted pass in Arrow batches; the only memory is the state, so a key may be of any size.
    """
    keys = [key] if isinstance(key, str) else key
    arrow = {"double": pa.float64(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[kind]
    columns = rows.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{output}` {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, begun = None, None, False
        for batch in batches:
            out = []
            for k, *values in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), *(batch.column(c).to_pylist() for c in inputs), strict=True):
                if not begun or k != current:
                    current, state, begun = k, start(), True
                state, o = step(state, *values)
                out.append(o)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*columns, output])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.3, least: int = 1) -> DataFrame:
    """Adds ``ema``, an exponential moving average that starts with the first value of a key; NULL before
    ``least`` values were seen.

    A step is the affine map s -> (1 - alpha) s + alpha v, and such maps compose, so a key is folded stretch by
    stretch: each gives its own average and what is left of the start, and a row per stretch carries the rest.
    """
    left = 1 - alpha
    cut = rows.withColumn("__st", stretch_of(order[0]))
    first = rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("__first"))
    # Within a stretch: the fold from 0, by a sorted pass, with the number of rows so far.
    part = folded(cut, [key, "__st"], order, [value], lambda: 0.0, lambda s, v: (left * s + alpha * v,) * 2, "__own")
    part = part.withColumn("__n", F.row_number().over(Window.partitionBy(key, "__st").orderBy(*order)))
    ends = part.groupBy(key, "__st").agg(F.max("__n").alias("__n"), F.max_by("__own", F.struct(*order)).alias("__own")).join(first, key)
    carried = folded(ends, [key], ["__st"], ["__own", "__n", "__first"], lambda: None, lambda s, own, n, v: ((own + left**n * (v if s is None else s)), v if s is None else s), "__carry").select(key, "__st", "__carry")
    out = part.join(carried, [key, "__st"]).withColumn("ema", F.col("__own") + F.pow(F.lit(left), F.col("__n")) * F.col("__carry"))
    if least > 1:
        out = running(out, key, order, stretch_of(order[0]), __seen=("sum", F.lit(1))).withColumn("ema", F.when(F.col("__seen") >= least, F.col("ema"))).drop("__seen")
    return out.drop("__st", "__own", "__n", "__carry")


def queue_times(queue: DataFrame, key: str, order: list[str], workers: int, service: str) -> DataFrame:
    """When each of a queue's jobs starts, if the first worker that is free takes the next (a heap)."""
    import heapq

    def step(heap: list, seconds: float) -> tuple[list, float]:
        at = heapq.heappop(heap)
        heapq.heappush(heap, at + seconds)
        return heap, at

    return folded(queue, key, order, [service], lambda: [0.0] * workers, step, "starts_at")


def water_marks(rows: DataFrame, key: str, order: list[str], size: str, high: float, low: float) -> DataFrame:
    """Size held after each row, if all above ``high`` makes the oldest go until ``low`` is met."""
    from collections import deque

    def step(state: list, n: float) -> tuple[list, float]:
        held, total = state
        held.append(n)
        total += n
        if total > high:
            while held and total > low:
                total -= held.popleft()
        return [held, total], float(total)

    return folded(rows, key, order, [size], lambda: [deque(), 0.0], step, "held")


def last_units(rows: DataFrame, key: str, newest: list[Column], units: int) -> DataFrame:
    """The last ``units`` rows of a key."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*newest))).filter(F.col("__rn") <= units).drop("__rn")
