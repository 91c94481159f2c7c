"""Keyed permutations of numbers and dates within their own format.

A balanced Feistel network over two halves of a domain of n numbers, made to fit by walking the cycle
until it lands inside. The same value under the same key always gives the same other value, different
values give different ones, and with the key the original can be had back.
"""

from __future__ import annotations

import hashlib
import math
from datetime import date, timedelta

ROUNDS = 8
#: Dates are permuted within these days.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2049, 12, 31)


def _round(key: bytes, tweak: str, i: int, half: int, size: int) -> int:
    mixed = hashlib.blake2b(f"{tweak}|{i}|{half}".encode(), key=key, digest_size=16).digest()
    return int.from_bytes(mixed, "big") % size


def permute(value: int, size: int, key: bytes, tweak: str = "", back: bool = False) -> int:
    """A permutation of 0 .. size - 1."""
    if size <= 1:
        return value
    side = math.isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, side)
        if back:
            for i in reversed(range(ROUNDS)):
                left, right = (right - _round(key, tweak, i, left, side)) % side, left
        else:
            for i in range(ROUNDS):
                left, right = right, (left + _round(key, tweak, i, right, side)) % side
        value = left * side + right
        if value < size:
            return value


def permute_digits(digits: str, key: bytes, tweak: str = "", back: bool = False) -> str:
    """Another string of as many digits."""
    return str(permute(int(digits), 10 ** len(digits), key, f"{tweak}{len(digits)}", back)).zfill(len(digits)) if digits else ""


def permute_day(day: date, key: bytes, back: bool = False) -> date:
    size = (LAST_DAY - FIRST_DAY).days + 1
    return FIRST_DAY + timedelta(permute((day - FIRST_DAY).days, size, key, "day", back))


def permute_in_place(text: str, key: bytes, tweak: str = "", keep: int = 0) -> str:
    """The digits of ``text`` after the first ``keep``, permuted; all else stays where it is."""
    at = [i for i, c in enumerate(text) if c in "0123456789"][keep:]
    new = permute_digits("".join(text[i] for i in at), key, tweak)
    out = list(text)
    for i, c in zip(at, new, strict=True):
        out[i] = c
    return "".join(out)
