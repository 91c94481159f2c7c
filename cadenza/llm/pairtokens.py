"""The texts of a batch as arrays of tokens, so that what is counted over words, clauses and shingles is
counted for thousands of pairs at once."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd

from cadenza.llm import pairtext as P

#: Kinds of tokens.
SEPARATOR, WORD, CJK, NUMBER, MARK, END, LINE = range(7)
#: Between two texts; taken out of the texts themselves.
NUL = "\x00"
_TOKENS = re.compile(rf"\x00|[{P.CJK}]|[^\W\d_{P.CJK}]+(?:['’][^\W\d_{P.CJK}]+)*|\d+(?:[.,]\d+)*|[,、;:()\"\n]|[.!?。…]+[\"”’)\]」』]*(?!\d)")
_APART = re.compile(f"(?<=[{P.CJK}]) (?=[{P.CJK}])")
#: Words that begin a new clause.
_LINKING = frozenset(("but", "that", "because", "although", "however"))

FIRST = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: What stands in front of the first token of a sentence.
_OPENING = np.uint64(0x2545F4914F6CDD1D)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def plain_all(texts: list[str]) -> list[str]:
    """``P.plain`` of each text, normalized in one go; NUL and NULL become nothing."""
    whole = NUL.join([t.replace(NUL, " ") if t else "" for t in texts])
    if not whole.isascii():
        whole = unicodedata.normalize("NFKC", whole).replace("’", "'").replace("‘", "'")
    return whole.split(NUL)


@dataclass
class Clauses:
    row: np.ndarray  # of each clause
    at: np.ndarray  # where its tokens begin, among ``token``
    size: np.ndarray  # number of its tokens
    token: np.ndarray  # index of each token of a clause among all tokens
    h: np.ndarray


@dataclass
class Contexts:
    """Hashes of the last tokens before each place of a sentence."""

    by_order: dict[int, tuple[np.ndarray, np.ndarray]]  # order -> (places that have it, hash); order 0: from the sentence's start
    kind: np.ndarray  # of each place: 0 to 3 as COUNTS of the pairs, -1 for one that does not count
    token: np.ndarray  # index of each place among all tokens


class Tokens:
    """Tokens of texts (plain, in lower case); numbers of rows are those of the texts."""

    def __init__(self, texts: list[str]) -> None:
        self.n_rows = len(texts)
        found = np.array(_TOKENS.findall(NUL.join(texts)), dtype=object)
        self.code, self.names = pd.factorize(found) if len(found) else (np.zeros(0, dtype=np.int64), found)
        self.kind_of = np.fromiter(map(_kind, self.names), dtype=np.int8, count=len(self.names))
        self.kind = self.kind_of[self.code]
        self.row = np.cumsum(self.kind == SEPARATOR)
        self.value_of = pd.util.hash_array(self.names, categorize=False) if len(self.names) else np.zeros(0, dtype=np.uint64)
        self.value = self.value_of[self.code]

    def flags(self, test: object) -> np.ndarray:
        """``test`` of each distinct token, for each token."""
        return np.fromiter(map(test, self.names), dtype=bool, count=len(self.names))[self.code]

    @cached_property
    def segment(self) -> np.ndarray:
        """Number of the sentence of each token."""
        closes = (self.kind == SEPARATOR) | (self.kind == END)
        return np.cumsum(closes) - closes

    @cached_property
    def has_end(self) -> np.ndarray:
        """Whether a sentence is closed by a full stop or the like."""
        closing = self.kind[(self.kind == SEPARATOR) | (self.kind == END)]
        return np.append(closing == END, False)

    def text_hashes(self) -> np.ndarray:
        """A hash of the words, characters and numbers of each row."""
        said = (self.kind == WORD) | (self.kind == CJK) | (self.kind == NUMBER)
        row, v = self.row[said], self.value[said]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        sums = np.zeros(self.n_rows, dtype=np.uint64)
        np.add.at(sums, row, mixed(v + _places(place)))
        return mixed(sums)

    def clauses(self, sentences: int = 3) -> Clauses:
        """Clauses of the first sentences of every row."""
        inside = self.kind_of != SEPARATOR
        linking = np.array([n in _LINKING or n in ",、;:" for n in self.names], dtype=bool) | (self.kind_of == LINE) | (self.kind_of == END) | ~inside
        broken = linking[self.code]
        number = np.cumsum(broken)
        token = np.flatnonzero(~broken)
        # The place of a sentence among those of its row that hold anything.
        segment = self.segment[token]
        new = np.append(True, segment[1:] != segment[:-1])[: len(token)]
        order = np.cumsum(new)
        row = self.row[token]
        first_of_row = order[np.searchsorted(row, row)] if len(row) else order
        early = order - first_of_row < sentences
        token = token[early]
        number, row = number[token], self.row[token]
        at = np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(token)])
        size = np.diff(np.append(at, len(token)))
        place = np.arange(len(token)) - np.repeat(at, size)
        sums = np.add.reduceat(mixed(self.value[token] + _places(place)), at) if len(at) else np.zeros(0, dtype=np.uint64)
        return Clauses(row[at], at, size, token, mixed(sums + size.astype(np.uint64)))

    def clause_text(self, tokens: np.ndarray) -> str:
        return _APART.sub("", " ".join(self.names[self.code[tokens]]))

    def contexts(self, n_rows: int, orders: tuple[int, ...]) -> Contexts:
        """Contexts in the first ``n_rows`` rows, numbers counting as one word."""
        token = np.flatnonzero((self.kind >= WORD) & (self.kind <= MARK) & (self.row < n_rows))
        value = self.value[token].copy()
        value[self.kind[token] == NUMBER] = FIRST
        segment, row = self.segment[token], self.row[token]
        new = np.append(True, segment[1:] != segment[:-1])[: len(token)]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(token)))
        place = np.arange(len(token)) - np.repeat(at, size)
        last = place == np.repeat(size - 1, size)

        ended = self.has_end[segment]
        with_end = np.bincount(row[at][ended[at]], minlength=n_rows)[row] > 0
        lone = (np.repeat(size, size) == 1) & np.fromiter((len(n) == 1 for n in self.names), dtype=bool, count=len(self.names))[self.code[token]]
        kind = np.where(~last, 1, np.where(ended, 0, np.where(with_end, 2, 3)))
        kind = np.where(~ended & ~last, -1, kind)  # in a sentence that is not ended only its end is counted
        kind = np.where(last & ~ended & with_end & lone, -1, kind)

        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        running = np.full(len(token), FIRST)
        whole_at, whole = [], []
        there = np.arange(len(token))
        for order in range(1, max(orders) + 1):
            there = there[place[there] >= order - 1]
            running[there] = mixed(running[there] ^ value[there - (order - 1)])
            if order in orders:
                found[order] = there, running[there]
            ends_here = there[place[there] == order - 1]
            whole_at.append(ends_here)
            whole.append(mixed(running[ends_here] ^ _OPENING))
        found[0] = np.concatenate(whole_at), np.concatenate(whole)
        return Contexts(found, kind, token)


def _places(place: np.ndarray) -> np.ndarray:
    return mixed(place.astype(np.uint64) * FIRST + FIRST)


def _kind(name: str) -> int:
    c = name[0]
    if c == NUL:
        return SEPARATOR
    if c == "\n":
        return LINE
    if c in ",、;:()\"":
        return MARK
    if c in ".!?。…":
        return END
    if c.isdigit():
        return NUMBER
    return CJK if "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" else WORD


# --- letters ---------------------------------------------------------------------------------------
BINS = 64
_IS_LETTER = np.fromiter((chr(i).isalnum() for i in range(0x10000)), dtype=bool, count=0x10000)


def letter_bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters and digits of each text, how many of them fall into each of BINS bins)."""
    points = np.frombuffer(NUL.join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.cumsum(points == 0)
    kept = _IS_LETTER[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
    row, points = row[kept], points[kept].astype(np.int64)
    bags = np.bincount(row * BINS + points % 61 % BINS, minlength=len(texts) * BINS).reshape(len(texts), BINS)
    return bags.sum(axis=1), bags.astype(np.int32)


def may_repeat(question_size: np.ndarray, question: np.ndarray, answer_size: np.ndarray, answer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs whose answer may be the question altered or doubled, pairs whose answer may hold it), by their
    letters: a copy lacks no more of them than may be altered, and one that is no more has few others."""
    lacking = np.maximum(question - answer, 0).sum(axis=1)
    altered = np.maximum(2, question_size // 8)
    all_there = (question_size >= 4) & (answer_size >= 0.75 * question_size) & (lacking <= altered)
    alone = (np.abs(answer_size - question_size) <= np.maximum(2, question_size // 6)) & (answer_size - question_size + lacking <= altered)
    doubled = (np.abs(answer_size - 2 * question_size) <= 2 * np.maximum(2, question_size // 6)) & (np.abs(answer - 2 * question).sum(axis=1) <= 4 * altered)
    return all_there & (alone | doubled), all_there


# --- languages -------------------------------------------------------------------------------------
def languages(tokens: Tokens) -> np.ndarray:
    """``P.language`` of every row without quoted words, by the same rules, as numbers into P.LANGUAGES."""
    counts_of = np.array([P.word_counts(n) if k in (WORD, CJK) else P.NO_COUNTS for n, k in zip(tokens.names, tokens.kind_of, strict=True)], dtype=np.int16).reshape(len(tokens.names), len(P.NO_COUNTS))
    counts = np.zeros((tokens.n_rows, len(P.NO_COUNTS)), dtype=np.int64)
    for j in range(counts.shape[1]):
        w = counts_of[:, j]
        if w.any():
            counts[:, j] = np.bincount(tokens.row, weights=w[tokens.code], minlength=tokens.n_rows)[: tokens.n_rows]
    cjk, words = counts[:, 0], counts[:, 1]
    scripts = counts[:, 2 : 2 + len(P.SCRIPTS)]
    latin = counts[:, 2 + len(P.SCRIPTS) :]
    script, most = scripts.argmax(axis=1), scripts.max(axis=1)
    best, top, english = latin.argmax(axis=1), latin.max(axis=1), latin[:, P.ENGLISH]
    n_scripts, unknown = len(P.SCRIPTS), len(P.LANGUAGES) - 1
    latin_code = np.where((best != P.ENGLISH) & (top >= 2) & (top > 1.5 * english), best, np.where(english > 0, P.ENGLISH, -1))
    out = np.where(latin_code >= 0, 2 + n_scripts + latin_code, unknown)
    out = np.where(words < 2, 0, out)
    out = np.where(cjk * 0.6 >= words, np.where(cjk > 1, 1, 0), out)
    out = np.where((most > 0) & (most >= words) & (5 * most >= cjk), 2 + script, out)
    return np.where((cjk == 0) & (words == 0) & (most == 0), 0, out)
