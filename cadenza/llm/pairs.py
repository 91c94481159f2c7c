"""Broken prompt and response pairs, each with its one type of defect.

Three things are asked of the corpus as a whole:

* Refusals. Clauses that responses open with are clustered by MinHash over word shingles, links being
  verified by the true similarity. A cluster that recurs across unrelated prompts and declines is a
  template of refusal, and every pair that opens with a member of it is a refusal. A declining clause
  outside of them is one if it holds, or is held in, a clause of a template.
* Termination. For the last words of a text without a full stop, the corpus tells how often the same
  words end a sentence and how often they go on.
* The rest (nothing said, the question again, another language) can be told from the pair alone.

Texts are read in batches, as arrays of tokens; only pairs that may be a copy or in another language by
what these arrays say are looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import pairtext as P
from cadenza.llm import pairtokens as K
from cadenza.session import cut_lineage

#: Words in a shingle, least similarity, and the bands of the signature (a link of 0.8 is missed once in 200).
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 10, 4
#: Words from which a clause can be as similar as SIMILARITY to another that has other shingles: of a and b > a
#: shingles at most a / b are shared, which is below 0.8 for a < 4.
LEAST_WORDS = SHINGLE + 3
#: Rows up to which a set of clauses is sent to all executors; larger ones are joined by shuffling.
SENT = 200_000
#: A template must open answers to so many different prompts that share no word with it.
PROMPTS = 2
#: Lengths of the contexts counted for termination; shorter ones only from the start of a sentence.
ORDERS = (5, 3, 2, 1)
#: A context ends its sentence in less than this share of its uses where a text was cut.
ENDS_BELOW = 0.1
#: Uses from which a context is trusted.
TRUSTED = 4
#: Distinct clauses remembered in a Python worker, so that each is handed on once, and contexts held back there
#: so that their counts are added up.
HELD = 500_000
#: Characters of texts worked on at a time; a longer text is worked on alone.
AT_ONCE = 2_000_000

#: The counts of a context: it ended a sentence, went on in one that is ended, and was the end of a text
#: without a full stop, after other sentences or as all there is.
COUNTS = ("ends", "goes_on", "cut", "cut_alone")

FOUND = pa.schema(
    [
        ("kind", pa.int8()),  # 0 a pair worth a look, 1 counts of contexts, 2 a clause, 3 openings, 4 openings that speak of the prompt
        ("pair_table", pa.string()),
        ("pair_id", pa.int64()),
        ("defect", pa.string()),
        ("alone", pa.bool_()),
        ("word", pa.bool_()),
        ("declines", pa.bool_()),
        ("orders", pa.list_(pa.int32())),
        ("hs", pa.list_(pa.int64())),  # of contexts or clauses; of one clause its shingles
        ("xs", pa.list_(pa.int64())),  # two counts in one number, or pairs
        ("ys", pa.list_(pa.int64())),  # two counts in one number, or prompts, or bands
    ]
)
FOUND_SPARK = "kind tinyint, pair_table string, pair_id bigint, defect string, alone boolean, word boolean, declines boolean, orders array<int>, hs array<bigint>, xs array<bigint>, ys array<bigint>"

_SEEDS = K.mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * K.FIRST)


def _rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in FOUND], schema=FOUND)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat.astype(np.int64)))


def _kinds(n: int, kind: int) -> pa.Array:
    return pa.array(np.full(n, kind, dtype=np.int8))


def _pieces(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
    """The batch as lists, so many rows at a time that their texts stay below AT_ONCE."""
    columns = {c: batch.column(c).to_pylist() for c in ("pair_table", "pair_id", "question", "answer", "interrupted")}
    if batch.nbytes <= AT_ONCE:
        yield columns
        return
    start, held = 0, 0
    for i, (q, a) in enumerate(zip(columns["question"], columns["answer"], strict=True)):
        size = len(q or "") + len(a or "")
        if held and held + size > AT_ONCE:
            yield {c: v[start:i] for c, v in columns.items()}
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield {c: v[start:] for c, v in columns.items()}


class _Inspector:
    """What the pairs of a partition say by themselves, and what of them is to be counted."""

    def __init__(self) -> None:
        self.seen: dict[int, bool] = {}  # clauses handed on, with whether they decline
        self.held: list[tuple[np.ndarray, np.ndarray]] = []  # contexts and their counts, not handed on yet

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                yield from self.inspect(**piece)
                if sum(len(h) for h, _ in self.held) > HELD:
                    yield from self.counts()
        yield from self.counts()

    def inspect(self, pair_table: list, pair_id: list, question: list, answer: list, interrupted: list) -> Iterator[pa.RecordBatch]:
        n = len(answer)
        answers = K.plain_all(answer)
        place: dict[str, int] = {}
        asked = np.fromiter((place.setdefault(q or "", len(place)) for q in question), dtype=np.int64, count=n)
        questions = K.plain_all(list(place))
        tokens = K.Tokens([t.lower() for t in answers] + [t.lower() for t in questions])
        table, ident = np.array(pair_table, dtype=object), np.array(pair_id, dtype=np.int64)

        defect = self.told_alone(answers, questions, asked, tokens)
        contexts = tokens.contexts(n, ORDERS)
        self.count(contexts)
        open_ = np.array([d is None for d in defect], dtype=bool)

        tails = []
        for i in np.flatnonzero(open_ & ~np.array(interrupted, dtype=bool)).tolist():
            if not P.surely_ended(answers[i]):
                how = P.ending(answers[i])
                if how == "open":
                    defect[i] = "truncated"
                elif how == "bare":
                    tails.append(i)
        flawed = np.flatnonzero([d is not None for d in defect])
        if len(flawed):
            yield _rows(len(flawed), kind=_kinds(len(flawed), 0), pair_table=pa.array(table[flawed]), pair_id=pa.array(ident[flawed]), defect=pa.array([defect[i] for i in flawed]))
        if tails:
            yield from self.tails(np.array(tails), table, ident, tokens, contexts)
        yield from self.openings(open_, table, ident, asked, n, tokens)

    def told_alone(self, answers: list[str], questions: list[str], asked: np.ndarray, tokens: K.Tokens) -> list[str | None]:
        """The defects a pair shows by itself: nothing said, the question again, another language."""
        n = len(answers)
        size, bags = K.letter_bags([t.lower() for t in answers] + [t.lower() for t in questions])
        again, holds = K.may_repeat(size[n:][asked], bags[n:][asked], size[:n], bags[:n])
        spoken = K.languages(tokens)
        a, q = spoken[:n], spoken[n:][asked]
        differ = (a != q) & (a != 0) & (q != 0)
        defect: list[str | None] = [None] * n
        for i in np.flatnonzero(size[:n] <= P.LONGEST_PLACEHOLDER).tolist():
            if P.is_empty(answers[i]):
                defect[i] = "empty"
        for i in np.flatnonzero(again | holds).tolist():
            q, text = questions[asked[i]], answers[i]
            if defect[i] is None and (again[i] or P.begins_again(q, text)) and P.question_copy(q, text):
                defect[i] = "question_copy"
        quoted = np.array(list(map(P.has_quotes, answers)), dtype=bool) | np.array(list(map(P.has_quotes, questions)), dtype=bool)[asked]
        for i in np.flatnonzero(differ | quoted).tolist():
            if defect[i] is None and questions[asked[i]] and P.other_language(questions[asked[i]], answers[i]):
                defect[i] = "other_language"
        return defect

    def count(self, contexts: K.Contexts) -> None:
        at = np.concatenate([found[0] for found in contexts.by_order.values()])
        h = np.concatenate([found[1] for found in contexts.by_order.values()])
        kind = contexts.kind[at]
        h, kind = h[kind >= 0], kind[kind >= 0]
        if len(h):
            code, names = pd.factorize(h)
            self.held.append((names, np.bincount(code * 4 + kind, minlength=4 * len(names)).reshape(-1, 4)))

    def counts(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            code, names = pd.factorize(np.concatenate([h for h, _ in self.held]))
            each = np.concatenate([n for _, n in self.held])
            sums = np.stack([np.bincount(code, weights=each[:, k], minlength=len(names)) for k in range(4)], axis=1).astype(np.int64)
            self.held.clear()
            one = np.array([len(names)])
            yield _rows(1, kind=_kinds(1, 1), hs=_lists(names, one), xs=_lists(sums[:, 0] << 32 | sums[:, 1], one), ys=_lists(sums[:, 2] << 32 | sums[:, 3], one))

    def tails(self, rows: np.ndarray, table: np.ndarray, ident: np.ndarray, tokens: K.Tokens, contexts: K.Contexts) -> Iterator[pa.RecordBatch]:
        """The contexts at the end of texts that were left without a full stop."""
        # The last place of each row, and whether it is in a sentence that is not ended.
        row_of = tokens.row[contexts.token]
        last = np.searchsorted(row_of, rows, side="right") - 1
        there = (last >= 0) & (row_of[np.maximum(last, 0)] == rows)
        there &= ~tokens.has_end[tokens.segment[contexts.token[np.maximum(last, 0)]]]
        rows, last = rows[there], last[there]
        if not len(rows):
            return
        orders, hashes = [], []
        for order, (at, h) in contexts.by_order.items():
            lookup = np.full(len(contexts.token), -1, dtype=np.int64)
            lookup[at] = np.arange(len(at))
            found = lookup[last]
            orders.append(np.where(found >= 0, order, -1))
            hashes.append(h[np.maximum(found, 0)].astype(np.uint64) if len(h) else np.zeros(len(last), dtype=np.uint64))
        order, h = np.stack(orders, axis=1), np.stack(hashes, axis=1)
        has = order >= 0
        sizes = has.sum(axis=1)
        ended = np.zeros(tokens.n_rows + 1, dtype=bool)
        ended[row_of[tokens.has_end[tokens.segment[contexts.token]]]] = True
        names = tokens.names[tokens.code[contexts.token[last]]]
        word = np.fromiter((x.isalpha() and not "㐀" <= x[0] <= "鿿" for x in names), dtype=bool, count=len(names))
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        yield _rows(len(rows), kind=_kinds(len(rows), 0), pair_table=pa.array(table[rows]), pair_id=pa.array(ident[rows]), alone=pa.array(~ended[rows]), word=pa.array(word), orders=pa.ListArray.from_arrays(offsets, pa.array(order[has].astype(np.int32))), hs=_lists(h[has], sizes))

    def openings(self, open_: np.ndarray, table: np.ndarray, ident: np.ndarray, asked: np.ndarray, n: int, tokens: K.Tokens) -> Iterator[pa.RecordBatch]:
        """Clauses the answers open with: which pairs have them, and each distinct one once.

        Clauses shorter than LEAST_WORDS that do not decline can be linked to nothing and are left out.
        """
        c = tokens.clauses()
        flagged = tokens.flags(P.may_decline)[c.token]
        hint = np.add.reduceat(flagged.astype(np.int64), c.at) > 0 if len(c.at) else np.zeros(0, dtype=bool)
        wanted = (c.row < n) & ((c.size >= LEAST_WORDS) | hint)
        wanted[wanted] = open_[c.row[wanted]]
        index = np.flatnonzero(wanted)
        if not len(index):
            return
        h, first, back = np.unique(c.h[index], return_index=True, return_inverse=True)
        declines = np.zeros(len(h), dtype=bool)
        fresh = []
        for j, (value, at) in enumerate(zip(h.tolist(), index[first].tolist(), strict=True)):
            known = self.seen.get(value)
            if known is None:
                known = bool(hint[at]) and P.declines(tokens.clause_text(c.token[c.at[at] : c.at[at] + c.size[at]]))
                self.seen[value] = known
                fresh.append(j)
            declines[j] = known
        long = c.size[index[first]] >= LEAST_WORDS
        handed = np.array(fresh, dtype=np.int64)
        handed = handed[long[handed] | declines[handed]] if len(handed) else handed
        if len(handed):
            yield self.distinct(c, index[first][handed], h[handed], declines[handed], tokens)
        if len(self.seen) > HELD:
            self.seen.clear()

        kept = (long | declines)[back]
        index, h = index[kept], h[back][kept]
        row = c.row[index]
        related = self.related(c, index, asked[row], n, tokens)
        prompt = tokens.text_hashes()[n:][asked[row]]
        for kind, part in ((3, ~related), (4, related)):
            for name in np.unique(table[row[part]].astype(str)) if part.any() else ():
                of = part & (table[row] == name)
                one = np.array([of.sum()])
                yield _rows(1, kind=_kinds(1, kind), pair_table=pa.array([name]), hs=_lists(h[of], one), xs=_lists(ident[row[of]], one), ys=_lists(prompt[of], one))

    def related(self, c: K.Clauses, index: np.ndarray, asked: np.ndarray, n: int, tokens: K.Tokens) -> np.ndarray:
        """Clauses that share more than a third of their words with the prompt they answer."""
        telling = tokens.flags(lambda x: len(x) > 3 or "㐀" <= x[0] <= "鿿")
        in_question = np.flatnonzero(telling & (tokens.row >= n) & (tokens.kind != K.SEPARATOR))
        width = len(tokens.names)
        words = np.unique((tokens.row[in_question] - n) * width + tokens.code[in_question])
        size = c.size[index]
        token = c.token[np.repeat(c.at[index] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())]
        keys = np.repeat(asked, size) * width + tokens.code[token]
        found = np.minimum(np.searchsorted(words, keys), max(len(words) - 1, 0))
        shared = (words[found] == keys) if len(words) else np.zeros(len(keys), dtype=bool)
        return np.add.reduceat(shared.astype(np.int64), np.append(0, np.cumsum(size)[:-1])) > np.maximum(2, size // 3)

    def distinct(self, c: K.Clauses, which: np.ndarray, h: np.ndarray, declines: np.ndarray, tokens: K.Tokens) -> pa.RecordBatch:
        """Clauses with their shingles in order and the bands of their signatures."""
        size = c.size[which]
        start = np.append(0, np.cumsum(size)[:-1])
        value = tokens.value[c.token[np.repeat(c.at[which] - start, size) + np.arange(size.sum())]]
        n_shingles = np.maximum(size - SHINGLE + 1, 1)
        at = np.append(0, np.cumsum(n_shingles)[:-1])
        inside = np.arange(n_shingles.sum()) - np.repeat(at, n_shingles)
        begin, left = np.repeat(start, n_shingles) + inside, np.repeat(size, n_shingles) - inside
        shingle = np.full(len(begin), K.FIRST)
        for k in range(SHINGLE):
            there = np.flatnonzero(left > k)
            shingle[there] = K.mixed(shingle[there] ^ value[begin[there] + k])
        band = np.empty((len(which), BANDS), dtype=np.uint64)
        for b in range(BANDS):
            band[:, b] = K.FIRST
            for r in range(ROWS):
                band[:, b] = K.mixed(band[:, b] ^ np.minimum.reduceat(K.mixed(shingle ^ _SEEDS[b * ROWS + r]), at))
        m = len(which)
        return _rows(m, kind=_kinds(m, 2), pair_id=pa.array(h.view(np.int64)), declines=pa.array(declines), hs=_lists(shingle, n_shingles), ys=_lists(band.ravel(), np.full(m, BANDS)))


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _Inspector()(batches)


def _where_small(df: DataFrame) -> DataFrame:
    """``df``, marked to be sent to all executors if it was counted to have at most SENT rows of a few numbers."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def similar(a: str, b: str) -> Column:
    """Whether two arrays of shingles have SIMILARITY of their union in common."""
    both = F.size(F.array_intersect(a, b))
    return both >= SIMILARITY * (F.size(F.array_distinct(F.col(a))) + F.size(F.array_distinct(F.col(b))) - both)


def cluster_openings(clauses: DataFrame) -> DataFrame:
    """Distinct (h, declines, shingles, bands) to (h, template) for every clause that is linked to a declining
    one, directly or through others: the least h of its connected component.

    The search starts at the declining clauses. All pairs of what was reached last and any clause of its
    buckets are verified, until nothing new is reached; a pair of two others can be no link of such a
    component. The labels then spread along the links until none changes, by two steps a round: each clause
    takes the least label around it, and then the label that this label has by then.
    """
    buckets = cut_lineage(clauses.select("h", F.posexplode("bands").alias("band", "value")))
    shingles = clauses.select("h", "shingles")
    new = reached = cut_lineage(clauses.filter("declines").select("h"))
    links = None
    while not new.isEmpty():
        # The bands of what was reached last, each with its clauses: the smaller side by far, on all but odd data.
        from_ = cut_lineage(buckets.join(_where_small(new), "h", "left_semi").withColumnRenamed("h", "a"))
        pairs = buckets.withColumnRenamed("h", "b").join(_where_small(from_), ["band", "value"]).filter("a != b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.join(shingles.select(F.col("h").alias("a"), F.col("shingles").alias("x")), "a").join(shingles.select(F.col("h").alias("b"), F.col("shingles").alias("y")), "b")
        found = cut_lineage(pairs.filter(similar("x", "y")).select("a", "b"))
        links = found if links is None else links.union(found)
        new = cut_lineage(found.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(reached, "h", "left_anti"))
        reached = reached.union(new)
    labels = cut_lineage(reached.select("h", F.col("h").alias("template")))
    if links is None:
        return labels
    both = cut_lineage(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    while True:
        near = both.join(labels.withColumnRenamed("h", "b"), "b").groupBy(F.col("a").alias("h")).agg(F.min("template").alias("near"))
        nearer = labels.join(near, "h", "left").select("h", "template", F.least("template", "near").alias("near"))
        far = nearer.select(F.col("h").alias("near"), F.col("near").alias("far"))
        new = cut_lineage(nearer.join(far, "near").select("h", F.col("far").alias("template"), (F.col("far") != F.col("template")).alias("changed")))
        labels = new.select("h", "template")
        if new.filter("changed").isEmpty():
            return labels


def held_in(clauses: DataFrame, known: DataFrame) -> DataFrame:
    """h of the ``clauses`` (h, shingles in order) that hold a ``known`` one or are held in it: of the shorter
    one's shingles SIMILARITY are in the other, however much the longer one adds. The last word of a clause
    may be broken off, so a clause without it counts as well."""
    cut = F.when(F.size("shingles") > 1, F.slice("shingles", 1, F.greatest(F.size("shingles") - 1, F.lit(1))))
    forms = clauses.select("h", F.explode(F.array_compact(F.array("shingles", cut))).alias("part")).select("h", F.array_distinct("part").alias("part"))
    a = forms.select("h", F.size("part").alias("n"), F.explode("part").alias("s"))
    b = known.select(F.col("h").alias("k"), F.array_distinct("shingles").alias("part")).select("k", F.size("part").alias("m"), F.explode("part").alias("s"))
    both = a.join(b, "s").groupBy("h", "n", "k", "m").agg(F.count(F.lit(1)).alias("both"))
    return both.filter(F.col("both") >= SIMILARITY * F.least("n", "m")).select("h").distinct()


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_table, pair_id, defect_type), one row per broken pair.

    ``pairs`` has pair_table, pair_id, question, answer, interrupted. Types, first that holds: empty,
    question_copy, other_language, refusal, truncated.

    Defined results: a NULL or blank answer is empty; a NULL question leaves copy and language open; a
    repeated row gives one result; texts are read whole; NULL interrupted counts as false; an empty
    table gives no rows; other columns are ignored.
    """
    rows = pairs.select("pair_table", F.col("pair_id").cast("bigint").alias("pair_id"), "question", "answer", F.coalesce("interrupted", F.lit(False)).alias("interrupted"))
    found = cut_lineage(rows.mapInArrow(_inspect, FOUND_SPARK))
    looked = found.filter("kind = 0")

    clauses = found.filter("kind = 2").select(F.col("pair_id").alias("h"), "declines", F.col("hs").alias("shingles"), F.col("ys").alias("bands"))
    clauses = cut_lineage(clauses.dropDuplicates(["h"]))  # a clause has the same shingles wherever it was met
    template = _where_small(cluster_openings(clauses))
    opening = found.filter("kind IN (3, 4)").select("pair_table", (F.col("kind") == 4).alias("related"), F.explode(F.arrays_zip("hs", "xs", "ys")).alias("o"))
    opening = opening.select("pair_table", "related", F.col("o.hs").alias("h"), F.col("o.xs").alias("pair_id"), F.col("o.ys").alias("prompt"))
    labelled = cut_lineage(opening.join(template, "h"))
    refusing = labelled.filter(~F.col("related")).groupBy("template").agg(F.approx_count_distinct("prompt").alias("prompts")).filter(F.col("prompts") >= PROMPTS)
    known = cut_lineage(template.join(refusing, "template", "left_semi").select("h"))
    alone = clauses.filter("declines").join(known, "h", "left_anti")
    refused = known.union(held_in(alone, clauses.join(_where_small(known), "h", "left_semi")))
    refusal = labelled.join(refused, "h", "left_semi").select("pair_table", "pair_id", F.lit("refusal").alias("seen"))

    bare = looked.filter("orders IS NOT NULL").select("pair_table", "pair_id", "alone", "word", F.explode(F.arrays_zip("orders", "hs")).alias("c"))
    bare = bare.select("pair_table", "pair_id", "alone", "word", F.col("c.orders").alias("o"), F.col("c.hs").alias("h"))
    counts = found.filter("kind = 1").select(F.explode(F.arrays_zip("hs", "xs", "ys")).alias("c")).select(F.col("c.hs").alias("h"), F.col("c.xs").alias("x"), F.col("c.ys").alias("y"))
    halves = lambda c: (F.shiftright(c, 32), F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    wanted = counts.join(bare.select("h").distinct(), "h", "left_semi").groupBy("h").agg(*(F.sum(v).alias(c) for c, v in zip(COUNTS, (*halves("x"), *halves("y")), strict=True)))
    known = bare.join(wanted, "h", "left").fillna(0, list(COUNTS))
    per_order = [F.sum(F.when(F.col("o") == o, F.col(c))).alias(f"{c}{o}") for o in (0, *ORDERS) for c in COUNTS]
    cut = known.groupBy("pair_table", "pair_id", "alone", "word").agg(*per_order)
    cut = cut.filter(_is_cut()).select("pair_table", "pair_id", F.lit("truncated").alias("seen"))

    sure = looked.filter("defect IS NOT NULL").select("pair_table", "pair_id", F.col("defect").alias("seen"))
    rank = F.array_position(F.array(*map(F.lit, ["empty", "question_copy", "other_language", "refusal", "truncated"])), F.col("seen"))
    return sure.unionByName(refusal).unionByName(cut).groupBy("pair_table", "pair_id").agg(F.min_by("seen", rank).alias("defect_type"))


def _is_cut() -> Column:
    """Whether a text breaks off, by what its last contexts do elsewhere: columns ends<o>, goes_on<o>,
    cut<o> and cut_alone<o> for the context of o tokens, o = 0 for a sentence of few tokens as a whole."""
    known = lambda o: F.coalesce(F.col(f"ends{o}") + F.col(f"goes_on{o}"), F.lit(0))
    alone = F.coalesce("cut_alone0", F.lit(0))
    cut = lambda o: F.coalesce(F.col(f"cut{o}") + F.col(f"cut_alone{o}"), F.lit(0))
    # Where a sentence may end, most texts have their full stop: cuts count as uses that did not end it.
    rarely_end = lambda o: F.coalesce(F.col(f"ends{o}"), F.lit(0)) < ENDS_BELOW * (known(o) + cut(o))
    half_a_word = F.col("word") & ((known(1) == 0) | ((cut(1) >= TRUSTED) & (cut(1) > known(1))))
    # Left over after other sentences again and again, hardly ever a whole answer: a beginning of something.
    leftover = (F.col("cut0") >= TRUSTED) & (alone < ENDS_BELOW * cut(0)) & rarely_end(0)

    by_context = F.when(half_a_word, F.lit(True))
    for o in (5, 3, 2):
        by_context = by_context.when(known(o) + cut(o) >= TRUSTED, rarely_end(o))
    by_context = by_context.otherwise((known(1) >= 5 * TRUSTED) & rarely_end(1))
    # A sentence so short that it is seen as a whole: known as a start that goes on, more often than it is
    # all there is, or else an answer of few words.
    short = F.when((known(0) >= 2) & (known(0) > alone), rarely_end(0)).when(leftover, F.lit(True)).when(half_a_word, F.col("ends2").isNotNull() | ~F.col("alone")).otherwise(F.lit(False))
    return F.when(F.col("ends0").isNotNull(), short).otherwise(by_context)
